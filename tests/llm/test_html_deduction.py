"""Template deduction against a plain second version, and broken markup in time by its length."""

import time
from collections import defaultdict

import pytest

from strandline.llm import html_extract as h

PAGE = "page_id long, url string, html string"


def plain_template(pages):
    """Hashes of the tokens of a host's valid classes, page by page from the definition."""
    pages = sorted(set(pages))
    if len(pages) < h.SUPPORT:
        return frozenset()
    rows = []
    for page in pages:
        places = defaultdict(list)
        for k, (token, text, _, junk) in enumerate(h.nodes(page)):
            if not (junk and text) and not token.endswith(":raw") and not text.isspace():
                places[h.token_hash(token, text)].append(k)
        rows.append(places)
    vectors = defaultdict(list)
    for token in {t for r in rows for t in r}:
        vector = tuple(len(r.get(token, ())) for r in rows)
        if sum(map(bool, vector)) >= max(h.SUPPORT, h.SHARE * len(pages)):
            vectors[vector].append(token)
    ways, fits = defaultdict(set), dict.fromkeys(vectors, True)
    for k, r in enumerate(rows):
        here = {v: sorted((r[t][0], t) for t in tokens) for v, tokens in vectors.items() if v[k]}
        span = {v: (c[0][0], max(r[t][-1] for _, t in c)) for v, c in here.items()}
        for v, c in here.items():
            order = [t for _, t in c]
            again = [r[t][1] for t in order if len(r[t]) > 1]
            ordered = order == [t for _, t in sorted((r[t][-1], t) for t in order)] and (not again or min(again) > c[-1][0])
            start, end = span[v]
            around = [(span[p][1] - span[p][0], p) for p in here if p[k] == 1 and span[p][0] < start and span[p][1] > end]
            narrow = min(w for w, _ in around) if around else None
            parent = next(p for w, p in around if w == narrow) if around else None
            assert sum(w == narrow for w, _ in around) <= 1  # a tie would leave the choice open
            gap = [sum(f < x for f, _ in here[parent]) for x in (start, end)] if parent else [None, None]
            fits[v] &= ordered and gap[0] == gap[1]
            ways[v].add((tuple(order), parent, gap[0]))
    return frozenset(t for v, tokens in vectors.items() if fits[v] and len(ways[v]) == 1 for t in tokens)


def hosted(spark, pages):
    return spark.createDataFrame([(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(pages)], PAGE)


def check(spark, pages):
    by_host = defaultdict(list)
    for host, page in pages:
        if page:
            by_host[host].append(page)
    template = {host: plain_template(own) for host, own in by_host.items()}
    got = {r.page_id: r.text for r in h.extract(hosted(spark, pages)).collect()}
    assert len(got) == len(pages)
    for k, (host, page) in enumerate(pages):
        assert got[k] == ("\n\n".join(h.blocks(page, template[host])) if page else ""), (k, host)
    return got, template


def recipe(i, notice="<p>Subscribe to our letter, it is free.</p>"):
    return f"<html><body><nav>menu</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs</li><li>{i * 7} g flour</li></ul><h2>Steps</h2><p>Stir {i} times.</p><h3>Join us</h3>{notice}</article><footer>f</footer></body></html>"


def test_headings_that_articles_share_stay_and_template_sections_go(spark):
    pages = [("a.org", recipe(i)) for i in range(8)] + [("few.org", recipe(99, '<div class="notice notice-info">cookies</div><section id="comments-section">first!</section><div class="promo-box">buy</div><div class="ad-slot">ad</div>')), ("a.org", None), ("a.org", "")]
    got, template = check(spark, pages)
    assert got[0] == "Dish 0\n\nIngredients\n\n0 eggs\n\n0 g flour\n\nSteps\n\nStir 0 times." and template["a.org"]
    assert got[8].endswith("Stir 99 times.\n\nJoin us") and got[9] == got[10] == ""


def test_headings_by_level():
    pages = [f"<article><h1>T{i}</h1><h2>Part</h2><h3>Sub</h3><p>x{i}</p><h3>Empty</h3><p>same</p><h2>Step <b>{i}</b></h2><p>y{i}</p><h2>End</h2></article>" for i in range(6)]
    template = plain_template(pages)
    assert h.blocks(pages[3], template) == ["T3", "Part", "Sub", "x3", "Step 3", "y3"]


def test_extraction_of_the_given_pages_is_that_of_the_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").orderBy("page_id").collect()
    hosts = [(r.url.split("://", 1)[-1].split("/", 1)[0].lower(), r.html) for r in rows]
    _, template = check(spark, hosts)
    assert sum(map(len, template.values())) > 0


@pytest.mark.parametrize("part, end", [("<a ", '"'), ('<a "x>y" ', '"'), ("<a 'x' ", "'"), ("<", ""), ("</", ""), ("<!", ""), ("<!--", ""), ("<script>", ""), ("<div>", ""), ('<a ">', ""), ("<p ", "'"), ('<article><p x="', ""), ("<a b='\" ", ""), ("<h1>", ""), ("&", "")])
def test_broken_markup_takes_time_by_its_length(part, end):
    took = []
    for size in (250_000, 1_000_000):
        page = part * (size // len(part)) + end
        began = time.process_time()
        h.blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < 2 or took[1] < 8 * took[0]  # 16 times if it were the square


def test_an_open_quote_loses_no_text_behind_it():
    assert h.blocks('<article><p title="oops>one</p><p>two</p></article>') == ["one", "two"]
    assert h.blocks('<article><p title="a>b">one</p></article>') == ["one"]
