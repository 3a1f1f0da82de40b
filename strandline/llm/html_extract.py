"""Main text of web pages by template deduction from the pages of a host.

Tokens of a page are its tags, each told apart by its place in the tag tree, and its text nodes. Tokens with the same
occurrence vector over the pages of a host form an equivalence class; a vector is represented by the sum of count times a
hash of the page, so equal vectors meet in one aggregate, combined before the shuffle, however many pages a host has. Equal
pages count once: a page is no template because it was copied.

A class is valid if enough pages have it, its tokens stand in one order on each of them (and where they repeat, a round
ends before the next begins), and it lies in the same gap of the same enclosing class on each of them. So the valid classes
nest into the host's template; what stands in the gaps between template tokens are the slots.

The main text is the content of the slots of the article. Template text goes, within an article as well: a notice or a
line that every page repeats, whatever its name; but a heading stays where slot text follows it. What varies from page to page
is slot text and stays, even in an element whose class sounds like boilerplate; within an article of a host with a template only
kinds of elements and exact names, not words in names, drop text. Where
a page marks no article, slots go that tag, role or a word of class or id know as menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles or comments.

Character references are decoded; white space inside a block becomes one space; blocks are joined by an empty line.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (an open tag, comment or
script at the end takes the rest; an article begins anew inside boilerplate that was not closed); a page without a host, or
whose host has few different pages, is read by its tags and names alone, compound names among them; where a quote is never closed, tags end at their first
`>`; repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

#: Pages of a host that a class must have: at least this many, and this share.
SUPPORT, SHARE = 4, 0.6
#: Template tokens of all hosts, and pages with copies, that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_TOKENS = 500_000

#: The kinds of elements. SKIP goes with all it holds, OUTSIDE only where no article holds it.
SKIP = frozenset("head nav footer aside form script style noscript template iframe button select textarea menu".split())
OUTSIDE = frozenset("header svg math canvas object audio video dialog".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Words of class and id that mean boilerplate outside an article; within one, whole class names, and whole attributes.
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|notices?|cookies?|consent|comments?|replies|disqus|footer|header|masthead|related|share|sharing|social|newsletter|subscri\w+|popup|modal|widget|toolbar|pagination|skip-?link)(?:$|[\s_-])")
NAMES = frozenset("ad ads advert adverts advertisement adsense sponsored sidebar navbar navigation breadcrumb breadcrumbs cookie-notice cookie-consent comments comment-list disqus_thread newsletter".split())
WHOLE = NAMES | frozenset("banner comment consent cookies footer menu modal nav notice notices pagination popup promo promotion related replies share sharing social subscribe toolbar widget".split())
#: Compound names that mean boilerplate within an article of a host without a template: what it is, then a part of a page.
COMPOUND = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|notices?|cookies?|comments?|replies|newsletter|subscri\w+)(?:[_-](?:area|banner|bar|block|body|box|container|form|info|item|list|message|section|signup|slot|text|thread|unit|warning|widget|wrapper))+(?=$|\s)")
ROLES = frozenset("navigation banner contentinfo complementary search form alert menu menubar".split())
ROLES_OUTSIDE = ROLES | {"dialog", "note"}

#: A token; quantifiers are possessive, so that each character is looked at once. The second one is for a page with a quote that
#: is never closed: its tags end at their first `>`.
_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
_TOKEN = re.compile(_OTHER + r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|[^<]++|<", re.DOTALL)
_PLAIN = re.compile(_OTHER + r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.DOTALL)
_TAG = re.compile(r"</?[a-zA-Z]")
_HEADING = re.compile(r"(?:^|\.)h([1-6])(?:\.[^.:]+)*:text$")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_SPACE = re.compile(r"\s+")


def attributes(text: str) -> dict[str, str]:
    if not text.strip(" /"):
        return {}
    return {(m[1] or m[5]).lower(): next((v for v in (m[2], m[3], m[4]) if v is not None), "") for m in _ATTRIBUTE.finditer(text)}


def is_boilerplate(tag: str, given: dict[str, str], in_article: bool, words: bool = False) -> bool:
    """words: compound names decide within an article as well, where no template does."""
    if tag in SKIP or tag in OUTSIDE and not in_article:
        return True
    if not given or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    role, names = given.get("role", ""), [given.get(k, "").lower().strip() for k in ("class", "id")]
    if in_article:
        return role in ROLES or any(x in WHOLE or not NAMES.isdisjoint(x.split()) or words and COMPOUND.search(x) for x in names)
    return role in ROLES_OUTSIDE or any(BOILERPLATE.search(x) for x in names)


def nodes(page: str, words: bool = False) -> Iterator[tuple[str, str, bool, bool]]:
    """(token, text, in an article, in boilerplate) in page order, in time by the page's length.

    token: a tag with its place in the tree; for text nodes the place, with the text beside it. words: see is_boilerplate."""
    pattern = _TOKEN
    stack: list[tuple[str, bool, bool]] = []  # tag, article, boilerplate
    opened: Counter[str] = Counter()  # how many elements of a name are open
    article = junk = False
    at, end = 0, len(page)

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < end:
        m = pattern.match(page, at)
        if m[0] == "<" and pattern is _TOKEN and _TAG.match(page, at):  # a quote is never closed; that is so for the rest of the page
            pattern = _PLAIN
            m = pattern.match(page, at)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                yield ".".join(s[0] for s in stack[-6:]) + ":text", m[0], article, junk
            continue
        if m[1]:  # an end tag closes up to the last open one of its name, or means nothing
            if opened[tag]:
                while pop() != tag:
                    pass
                _, article, junk = stack[-1] if stack else ("", False, False)
                yield f"/{tag}", "", article, junk
            continue
        if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
            _, article, junk = stack[-1] if stack else ("", False, False)
        given = attributes(m[3] or "")
        if tag in ("article", "main") and not article:
            own, bad = True, opened["template"] > 0
        else:
            own, bad = article, junk or is_boilerplate(tag, given, article, words)
        yield ".".join(s[0] for s in stack[-6:]) + f".{tag}" + (f"#{given['class']}" if given.get("class") else ""), "", own, bad
        if tag in VOID or (m[3] or "").endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            yield f"{tag}:raw", page[at:stop], own, True
            at = stop
        stack.append((tag, own, bad))
        opened[tag] += 1
        article, junk = own, bad


def token_hash(token: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{token}\0{_SPACE.sub(' ', text).strip()}") >> 1


def _spaced(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def blocks(page: str, template: frozenset[int] = frozenset()) -> list[str]:
    """Text blocks of the article's slots; where there is no article, of all slots outside boilerplate.

    A heading of the article that is template text stays if slot text follows it before the next heading of its level: the
    sections of a host's articles have their headings in common. Without a template compound names are boilerplate, too."""
    found: dict[bool, list[str]] = {True: [], False: []}
    open_: dict[bool, list[str]] = {True: [], False: []}
    headings: list[tuple[int, str]] = []  # template headings of which it is not known yet whether a slot follows
    within = 0  # the level of one that is still open

    def close() -> None:
        for k, parts in open_.items():
            if parts and (text := _spaced("".join(parts))):
                found[k].append(text)
            parts.clear()

    marked = False
    for token, text, article, junk in nodes(page, not template):
        if not text:
            tag = token.rpartition(".")[2].partition("#")[0].lstrip("/")
            if tag in BLOCK:
                close()
                within = 0
            elif tag == "br":
                for parts in open_.values():
                    parts.append(" ")
            marked |= article and not token.startswith("/")
        elif not junk and (not template or token_hash(token, text) not in template):
            if headings and article and not text.isspace():
                if within:  # the rest of that heading is slot text
                    open_[True].append(headings.pop()[1])
                found[True] += [t for _, raw in headings if (t := _spaced(raw))]
                headings.clear()
            open_[article].append(text)
        elif not junk and article and (m := _HEADING.search(token)):
            level = int(m[1])
            if within == level and headings:
                headings[-1] = (level, headings[-1][1] + text)
            else:
                headings[:] = [h for h in headings if h[0] < level]
                headings.append((level, text))
            within = level
    close()
    return found[True] if marked else found[False]


def token_rows(pages: DataFrame) -> DataFrame:
    """(host, page, token, n, first, second, last): places of each token of each page (page, the hash of its content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out: dict[str, list] = {k: [] for k in schema.names}
            for host, number, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places: dict[int, list[int]] = {}
                for k, (token, text, _, junk) in enumerate(nodes(page)):
                    if not (junk and text) and not token.endswith(":raw") and not text.isspace():
                        places.setdefault(token_hash(token, text), []).append(k)
                for h, at in places.items():
                    for name, value in zip(out, (host, number, h, len(at), at[0], at[1] if len(at) > 1 else None, at[-1]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("host", pa.string()), *((n, pa.int64()) for n in ("page", "token", "n", "first", "second", "last"))])
    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, token long, n long, first long, second long, last long")


def _small(df: DataFrame, kind: str) -> DataFrame:
    """df stored, and broadcast where its checked size allows."""
    df = stored(df, kind)
    return F.broadcast(df) if df.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else df


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): hashes of the tokens of each host's valid, nested equivalence classes. pages: page_id, host, html."""
    hashed = pages.where("host is not null and html is not null").withColumn("page", F.shiftrightunsigned(F.xxhash64("html"), 24))
    rows = stored(token_rows(hashed), "tokens")
    different = hashed.groupBy("host", "page").agg(F.count("*").alias("copies"))
    sizes = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT).withColumnRenamed("host", "of")
    # each of m equal pages counts for 1/m; their share of a vector is the same for all its tokens
    copied = _small(different.where("copies > 1").select(F.col("host").alias("ch"), F.col("page").alias("cp"), "copies"), "copies")
    weighed = rows.join(copied, (F.col("host") == F.col("ch")) & (F.col("page") == F.col("cp")), "left")
    vectors = weighed.groupBy("host", "token").agg(F.round(F.sum(1 / F.coalesce("copies", F.lit(1))), 3).alias("on"), F.sum((F.col("n") * F.col("page")).cast("decimal(38,0)")).alias("vector"))
    often = vectors.where(F.col("on") >= SUPPORT).join(sizes, F.col("host") == F.col("of")).where(F.col("on") >= F.col("pages") * SHARE)
    classes = _small(often.select(F.col("host").alias("h"), F.col("token").alias("t"), F.xxhash64("vector").alias("class")), "classes")
    # one row for each class of each page: its tokens in order, whether they are in order, and the span of each round
    on_page = rows.join(classes, (F.col("host") == F.col("h")) & (F.col("token") == F.col("t"))).groupBy("host", "page", "class").agg(
        F.array_sort(F.collect_set(F.struct("first", "token"))).alias("by_first"), F.array_sort(F.collect_set(F.struct("last", "token"))).alias("by_last"),
        F.min("second").alias("again"), F.max("first").alias("round_end"), F.min("first").alias("start"), F.max("last").alias("end"), F.max("n").alias("n"),
    )
    tokens = lambda c: F.transform(c, lambda x: x["token"])
    ordered = (tokens("by_first") == tokens("by_last")) & (F.coalesce("again", F.lit(1 << 62)) > F.col("round_end"))
    on_page = on_page.select("host", "page", "class", "start", "end", "n", ordered.alias("ordered"), F.xxhash64(tokens("by_first")).alias("order"), F.transform("by_first", lambda x: x["first"]).alias("places"))
    # the enclosing class: of those that occur once and span more, the narrowest; its gap: how many of its tokens stand before
    every = on_page.groupBy("host", "page").agg(F.collect_list(F.struct("class", "start", "end", "n", "ordered", "order", "places")).alias("c"))

    def nested(c):
        around = F.filter("c", lambda p: (p["n"] == 1) & (p["start"] < c["start"]) & (p["end"] > c["end"]))
        parent = F.array_min(F.transform(around, lambda p: F.struct((p["end"] - p["start"]).alias("width"), p["class"].alias("class"), p["places"].alias("places"))))
        before = lambda at: F.size(F.filter(parent["places"], lambda x: x < at))
        return F.struct(c["class"].alias("class"), (c["ordered"] & (parent.isNull() | (before(c["start"]) == before(c["end"])))).alias("fits"), F.xxhash64(c["order"], parent["class"], before(c["start"])).alias("way"))

    ways = every.select("host", F.explode(F.transform("c", nested)).alias("w")).groupBy("host", "w.class").agg(F.bool_and("w.fits").alias("fits"), (F.min("w.way") == F.max("w.way")).alias("same"))
    valid = ways.where("fits and same").select(F.col("host").alias("vh"), F.col("class").alias("vc"))
    return classes.join(valid, (F.col("h") == F.col("vh")) & (F.col("class") == F.col("vc"))).groupBy(F.col("h").alias("host")).agg(F.collect_list("t").alias("tokens"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))
    named = named.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    known = stored(templates(named), "templates").withColumnRenamed("host", "of")
    few = (known.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= BROADCAST_TOKENS
    joined = named.join(F.broadcast(known) if few else known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "tokens")
    names = ["page_id", "url", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts = ["\n\n".join(blocks(page, frozenset(tokens or ()))) if page else "" for page, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=names)

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
