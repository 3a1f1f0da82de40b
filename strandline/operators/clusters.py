"""Files that are alike, and clusters of files merged and split to a wanted number.

`similar_pairs` joins files by the sets of what they depend on. A score above 0.8 needs a shared dependency: the other parts
give 0.8 at most, so the Jaccard share of the dependencies is at least `need` = (least - 0.8) / 0.2, the language is the same,
complexities are at most 50 (1 - need) apart, and folders are at least (least - 0.7) / 0.3 alike. Two sets with that share have
one of their rarest dependencies in common (prefix filter, rare ones first) and sizes in that proportion (length filter). So
files meet at a rare dependency. A dependency that more than `CROWD` files have in their prefix is split: there files meet only
with those near in complexity and alike in folder, by keys that every such pair shares. Nothing is left out: the keys follow
from the least score, and each pair that meets is scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.files import PARTS, similarity

#: Classes that share a rare dependency above which they meet by complexity and folder, too.
CROWD = 200


def classes(files: DataFrame) -> DataFrame:
    """Files (project_id, file_path, PARTS) that score alike as one class: file_path, the first of them, and files, how many."""
    return files.groupBy("project_id", *PARTS).agg(F.count("*").alias("files"), F.min("file_path").alias("file_path"))


def similar_pairs(files: DataFrame, least: float = 0.9, crowd: int = CROWD) -> DataFrame:
    """(project_id, a, b, pairs, score) of the classes of a project that score at least `least`, which is above 0.8."""
    if not 0.8 < least <= 1:
        raise ValueError("least is above 0.8, where a dependency is shared, and at most 1")
    need = (least - 0.8) / 0.2 - 1e-9
    apart, alike = 50 * (1 - need) + 1e-6, (least - 0.7) / 0.3 - 1e-9
    own = classes(files.where(F.size("dependencies") > 0)).withColumn("dependencies", F.array_distinct("dependencies"))
    where = ["project_id", "language", "dependency"]
    each = own.select("*", F.explode("dependencies").alias("dependency"))
    counted = each.groupBy(*(F.col(c).alias(f"c_{c}") for c in where)).agg(F.count("*").alias("often"))
    same = (F.col("project_id") == F.col("c_project_id")) & F.col("language").eqNullSafe(F.col("c_language")) & (F.col("dependency") == F.col("c_dependency"))
    # one row for each dependency of each class, rarest first; the first |d| - need |d| + 1 of them are its prefix
    ranked = each.join(counted, same).drop(*(f"c_{c}" for c in where))
    order = Window.partitionBy("project_id", *PARTS).orderBy("often", "dependency")
    size = F.size("dependencies")
    prefix = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size - F.ceil(need * size) + 1).drop("place", "often")
    crowds = prefix.groupBy(*(F.col(c).alias(f"c_{c}") for c in where)).agg(F.count("*").alias("n")).where(F.col("n") > crowd).withColumn("crowded", F.lit(True)).drop("n")
    rows = prefix.join(crowds, same, "left").drop(*(f"c_{c}" for c in where))
    keys = F.when(F.col("crowded"), _folder_keys(alike)).otherwise(F.array(F.struct(F.lit("").alias("k"), F.lit(True).alias("x"), F.lit(True).alias("y"))))
    band = F.floor(F.col("complexity") / max(apart, 1e-6))
    rows = rows.withColumn("key", F.explode(keys))
    bands = lambda *n: F.when(F.col("crowded"), F.array(*(band + k for k in n))).otherwise(F.array(F.lit(0).cast("long")))
    a = rows.where("key.x").select("*", F.explode(bands(0)).alias("band"))
    b = rows.where("key.y").select("*", F.explode(bands(-1, 0, 1)).alias("band"))
    met = a.alias("a").join(b.alias("b"), (F.col("a.project_id") == F.col("b.project_id")) & F.col("a.language").eqNullSafe(F.col("b.language")) & (F.col("a.dependency") == F.col("b.dependency")) & (F.col("a.key.k") == F.col("b.key.k")) & (F.col("a.band") == F.col("b.band")))
    few, many = (f(F.size("a.dependencies"), F.size("b.dependencies")) for f in (F.least, F.greatest))
    met = met.where((F.col("a.file_path") != F.col("b.file_path")) & (few >= need * many) & (F.abs(F.col("a.complexity") - F.col("b.complexity")) <= apart))
    met = met.select(F.col("a.project_id").alias("project_id"), *(F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("file_path", "files", *PARTS))).alias(s) for s in "ab"))
    score = F.round(similarity({c: F.col(f"a.{c}") for c in PARTS}, {c: F.col(f"b.{c}") for c in PARTS}), 6)
    pairs = met.select("project_id", F.least("a.file_path", "b.file_path").alias("a"), F.greatest("a.file_path", "b.file_path").alias("b"), (F.col("a.files") * F.col("b.files")).alias("pairs"), score.alias("score"))
    return pairs.where(F.col("score") >= least).distinct()


def _folder_keys(alike: float) -> Column:
    """Keys (k, x, y) of a folder: pairs of which one has k as x and the other as y are all that can be that much alike.

    A folder whose name begins with the other's: the shorter has its name as x, the longer all it begins with as y. Otherwise so
    many parts are shared that, in order of the alphabet, one of the first ones is."""
    name = F.array_join("dir", "/")
    parts = F.array_sort(F.array_distinct("dir"))
    first = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.ceil(alike * F.size(parts)).cast("int") + 1, F.lit(1)))
    key = lambda k, x, y: F.struct(k.alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    begins = F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: key(F.concat(F.lit("b:"), F.substr(name, F.lit(1), n)), False, True))
    shared = F.transform(first, lambda p: key(F.concat(F.lit("p:"), p), True, True))
    return F.concat(F.array(key(F.concat(F.lit("b:"), name), True, False)), begins, shared)


def _scored(a: str, b: str) -> Column:
    return similarity({c: F.col(f"{a}_{c}") for c in PARTS}, {c: F.col(f"{b}_{c}") for c in PARTS})


def normalize(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame], fewest: int = 5, most: int = 25, large: int = 20, threshold: float = 0.65) -> DataFrame:
    """(project_id, file_path, cluster) of files (project_id, file_path, cluster, PARTS), with the number of clusters brought
    between `fewest` and `most`.

    While a project has too many, its smallest cluster (of equal ones the first by name) joins the one whose first file is most
    like its own (of equal ones the first by name), which keeps its first file. A project with too few has its largest
    cluster, if of more than `large` files, split: the first file that is left leads a part, and takes all that are more alike
    than the threshold. Clusters, not files, are what the merging works on; each round is one join for all projects at once, and
    ends when no project changed. keep writes a frame and reads it again, which cuts the lineage of the rounds."""
    lead = F.min_by(F.struct(*PARTS), F.struct("file_path", "complexity")).alias("x")
    state = files.groupBy("project_id", "cluster").agg(F.count("*").alias("n"), lead).select("project_id", "cluster", "n", *(F.col(f"x.{c}").alias(f"a_{c}") for c in PARTS))
    state = keep(state, "clusters")
    moves = None
    while True:
        counted = state.withColumn("count", F.count("*").over(Window.partitionBy("project_id"))).where(F.col("count") > most)
        small = counted.groupBy("project_id").agg(F.min_by(F.struct("cluster", "n", *(f"a_{c}" for c in PARTS)), F.struct("n", "cluster")).alias("s"))
        small = keep(small.select(F.col("project_id").alias("p"), F.col("s.cluster").alias("gone"), F.col("s.n").alias("gone_n"), *(F.col(f"s.a_{c}").alias(f"b_{c}") for c in PARTS)), "smallest")
        if small.isEmpty():
            break
        others = state.join(small, (F.col("project_id") == F.col("p")) & (F.col("cluster") != F.col("gone")))
        best = others.groupBy("p", "gone", "gone_n").agg(F.min_by("cluster", F.struct(-_scored("b", "a"), "cluster")).alias("into"))
        best = keep(best, "merges")
        state = state.join(best.select(F.col("p").alias("q"), "gone", "gone_n", "into"), F.col("project_id") == F.col("q"), "left").where("gone is null or cluster <> gone")
        state = keep(state.withColumn("n", F.when(F.col("cluster") == F.col("into"), F.col("n") + F.col("gone_n")).otherwise(F.col("n"))).select("project_id", "cluster", "n", *(f"a_{c}" for c in PARTS)), "clusters")
        step = best.select("p", "gone", "into")
        if moves is None:
            moves = step
        else:  # what went into a cluster goes with it
            moves = moves.join(step.select(F.col("p").alias("q"), F.col("gone").alias("via"), F.col("into").alias("next")), (F.col("p") == F.col("q")) & (F.col("into") == F.col("via")), "left").select("p", "gone", F.coalesce("next", "into").alias("into")).unionByName(step)
        moves = keep(moves, "moves")
    placed = files
    if moves is not None:
        placed = files.join(moves, (F.col("project_id") == F.col("p")) & (F.col("cluster") == F.col("gone")), "left").withColumn("cluster", F.coalesce("into", "cluster")).select(files.columns)
    largest = state.groupBy("project_id").agg(F.count("*").alias("count"), F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("largest"), F.max("n").alias("n"))
    split = keep(largest.where((F.col("count") < fewest) & (F.col("n") > large)).select(F.col("project_id").alias("p"), "largest"), "split")
    if split.isEmpty():
        return placed.select("project_id", "file_path", "cluster")
    inside = placed.join(split, (F.col("project_id") == F.col("p")) & (F.col("cluster") == F.col("largest")), "left")
    left = keep(inside.where("largest is not null").select(*files.columns), "unassigned")
    done, part = None, 1
    while not left.isEmpty():
        first = left.groupBy(F.col("project_id").alias("p")).agg(F.min_by(F.struct("file_path", *PARTS), F.struct("file_path", "complexity")).alias("lead"))
        met = left.join(first, F.col("project_id") == F.col("p"))
        near = (F.col("file_path") == F.col("lead.file_path")) | (similarity({c: F.col(f"lead.{c}") for c in PARTS}, {c: F.col(c) for c in PARTS}) > threshold)
        met = keep(met.select(*left.columns, near.alias("near")), "parts")
        took = met.where("near").select("project_id", "file_path", F.concat("cluster", F.lit(f" (Part {part})")).alias("cluster"))
        done, part = took if done is None else done.unionByName(took), part + 1
        left = met.where("not near").drop("near")
    return inside.where("largest is null").select("project_id", "file_path", "cluster").unionByName(done)
