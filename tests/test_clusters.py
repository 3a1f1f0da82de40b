"""Alike files and clusters against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from strandline.operators import clusters
from strandline.streaming.jobs import kept

FILE = "project_id string, file_path string, language string, dir array<string>, dependencies array<string>, complexity long"


def score(a, b):
    (_, _, la, da, xa, ca), (_, _, lb, db, xb, cb) = a, b
    fa, fb = "/".join(da), "/".join(db)
    folder = 1.0 if fa == fb else 0.7 if fa.startswith(fb) or fb.startswith(fa) else len(set(da) & set(db)) / max(len(da), len(db), 1)
    both = len(set(xa) | set(xb))
    shared = len(set(xa) & set(xb)) / both if both else 0.0
    return max(0.0, min(1.0, 0.3 * (la == lb) + 0.3 * folder + 0.2 * shared + 0.2 * max(0.0, 1 - abs(ca - cb) / 50)))


def some_files(rng, n, projects=2):
    dirs = [["src"], ["src", "a"], ["src", "ab"], ["lib", "a"], [], ["src", "a", "b"], ["x", "y", "z"], ["x", "y", "w"]]
    deps = ["A", "B", "C", "D", "E", "Common"]
    return [(f"p{k % projects}", f"f{k:04}", rng.choice(["cs", "py", None]), rng.choice(dirs), rng.sample(deps, rng.randrange(0, 5)), rng.choice([0, 1, 5, 30, 60])) for k in range(n)]


@pytest.mark.parametrize("least, crowd", [(0.81, 1000), (0.81, 0), (0.85, 5), (0.9, 0), (0.95, 1000), (1.0, 0)])
def test_similar_pairs_are_those_of_brute_force(spark, least, crowd):
    rows = some_files(random.Random(int(least * 100) + crowd), 150)
    named = {}
    for r in rows:
        named.setdefault((r[0], r[2], tuple(r[3]), tuple(r[4]), r[5]), []).append(r)
    firsts = [(min(v), len(v)) for v in named.values()]
    want = set()
    for i, (a, n) in enumerate(firsts):
        for b, m in firsts[i + 1 :]:
            if a[0] == b[0] and round(score(a, b), 6) >= least:
                x, y = sorted((a[1], b[1]))
                want.add((a[0], x, y, n * m, round(score(a, b), 6)))
    got = clusters.similar_pairs(spark.createDataFrame(rows, FILE), least, crowd).collect()
    assert {(r.project_id, r.a, r.b, r.pairs, r.score) for r in got} == want and len(got) == len(want)


def test_no_bucket_grows_with_the_square(spark):
    """A dependency that all files have: they meet only where folder and complexity are near."""
    rows = [("p", f"f{k:04}", "cs", ["src", f"m{k % 40}"], ["System"], (k * 37) % 4000) for k in range(1200)]
    got = clusters.similar_pairs(spark.createDataFrame(rows, FILE), 0.99, 50)
    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[3] == b[3] and abs(a[5] - b[5]) <= 2.5}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_least_scores_without_a_shared_dependency_are_refused(spark):
    with pytest.raises(ValueError, match="above 0.8"):
        clusters.similar_pairs(spark.createDataFrame([], FILE), 0.8)
    assert clusters.similar_pairs(spark.createDataFrame([], FILE), 0.9).count() == 0


def plain_normalize(rows, cluster_of, fewest, most, large, threshold):
    """The loop over one project at a time."""
    out = {}
    for project in sorted({r[0] for r in rows}):
        groups = defaultdict(list)
        for r in rows:
            if r[0] == project:
                groups[cluster_of[r[1]]].append(r)
        lead = {c: min(v, key=lambda r: (r[1], r[5])) for c, v in groups.items()}
        while len(groups) > most:
            small = min(groups, key=lambda c: (len(groups[c]), c))
            into = min((c for c in groups if c != small), key=lambda c: (-score(lead[small], lead[c]), c))
            groups[into] += groups.pop(small)
        if len(groups) < fewest and groups:
            big = min(groups, key=lambda c: (-len(groups[c]), c))
            if len(groups[big]) > large:
                left, part = sorted(groups.pop(big), key=lambda r: (r[1], r[5])), 0
                while left:
                    part += 1
                    groups[f"{big} (Part {part})"] = [r for r in left if r[1] == left[0][1] or score(left[0], r) > threshold]
                    taken = {r[1] for r in groups[f"{big} (Part {part})"]}
                    left = [r for r in left if r[1] not in taken]
        out |= {(project, r[1]): c for c, v in groups.items() for r in v}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_come_to_the_wanted_number(spark, seed):
    rng = random.Random(seed)
    rows = some_files(rng, 120, 3)
    cluster_of = {r[1]: f"c{rng.randrange(12)}" if r[0] != "p2" else f"c{rng.randrange(2)}" for r in rows}
    df = spark.createDataFrame([(*r, cluster_of[r[1]]) for r in rows], FILE + ", cluster string")
    got = clusters.normalize(df, kept, fewest=5, most=7, large=15, threshold=0.65).collect()
    assert {(r.project_id, r.file_path): r.cluster for r in got} == plain_normalize(rows, cluster_of, 5, 7, 15, 0.65)
    n = Counter(p for p, _ in {(r.project_id, r.cluster) for r in got})
    assert n["p0"] == n["p1"] == 7 and n["p2"] > 2 and len(got) == len(rows)


def test_clusters_of_nothing(spark):
    assert clusters.normalize(spark.createDataFrame([], FILE + ", cluster string"), kept).count() == 0
