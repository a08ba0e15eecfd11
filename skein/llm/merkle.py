"""Operator 13: Merkle dataset manifest, proofs by descent through content-addressed records.

``build`` ranks the leaves of each group (by order key, equal keys by digest),
then makes one table of records (digest -> children) a level: ``FAN`` consecutive
nodes become the SHA-256 of their joined hex digests until one is left, the
group's subroot. Subroots, by group, get a tree of their own that ends in the root.

``prove`` descends from the root: a frontier row is a node (digest, index)
with the path so far. Joining it with the records of its level by digest alone
gives the children; the digits of a leaf's rank in base ``FAN`` select one, the
unselected ones become a path segment. Requests under one node share its
frontier row, so the root is one row and not one row a leaf, and no join key is
hot. A leaf meets its path at the last level, and the segments are reversed,
which gives the proof from the leaf up.

No text is shuffled: a leaf is 64 characters from the first pass on. A frontier
row is as long as its path (at most FAN - 1 digests a level), and the last
frontier holds a row for each ``FAN`` leaves.

Cases: a null value of a leaf column counts as ``-``; null groups come first and
are a group like any other, null order keys come first within it; rows of an
equal key are ordered by digest, equal rows stay rows of their own (one place
each); a group of one leaf has that leaf as its subroot; one group has its subroot
as the root; an empty table gives no rows and the root None; very long texts are
hashed whole; further columns are kept only if named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.scratch import save
from skein.session import shuffle_partitions

FAN = 8
ROW_BITS = 33                       # monotonically_increasing_id: partition above, row below
PATH = "array<struct<l: string, r: string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and its text; ``-`` if null."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with FAN^h >= n."""
    out = F.lit(0)
    for h in range(21):
        out = F.when(n > F.lit(FAN ** h), F.lit(h + 1)).otherwise(out)
    return out


@dataclass
class Tree:
    """``leaves``: part, h, rank, leaf and what was kept; ``levels[k - 1]``: part, h, idx, digest, children of level k."""
    leaves: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(part, h, digest): the node each part ends in."""
        out = self.leaves.filter("h = 0").select("part", "h", F.col("leaf").alias("digest"))
        for k, level in enumerate(self.levels, 1):
            out = out.unionByName(level.filter(F.col("h") == k).select("part", "h", "digest"))
        return out


@dataclass
class Manifest:
    group: str
    groups: DataFrame               # part, <group>
    tree: Tree
    top: Tree                       # one part 0, whose leaves are the subroots; kept: of_part, of_h
    root: str | None

    def store(self) -> DataFrame:
        """(digest, children): every record once."""
        out = None
        for level in [*self.tree.levels, *self.top.levels]:
            level = level.select("digest", "children")
            out = level if out is None else out.unionByName(level)
        return out if out is None else out.dropDuplicates(["digest"])


def _ranked(rows: DataFrame, part: str | None, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in one global order (part, order): (rows with _at, counts by (part, _task) with the first _at).

    The order is dealt by ranges of all its columns, so neither a hot part nor
    a hot key lands in one task; the last column only parts equal rows."""
    spark = rows.sparkSession
    fixed = save(rows.withColumn("_u", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [*([part] if part else []), *order, "_u"]
    dealt = fixed.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    dealt = save(dealt.drop("_u").withColumn("_at", F.monotonically_increasing_id()), f"{name}-order") \
        .withColumn("_task", F.shiftright("_at", ROW_BITS))
    counts = dealt.groupBy(*([part] if part else []), "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return dealt, counts


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    top = leaves.agg(F.max("h").alias("h")).first()["h"] or 0
    nodes, out = leaves.select("part", "h", "rank", F.col("leaf").alias("digest")), []
    for k in range(1, top + 1):
        kids = F.array_sort(F.collect_list(F.struct("rank", "digest")))        # FAN rows at most
        level = nodes.filter(F.col("h") >= k) \
            .groupBy("part", "h", F.floor(F.col("rank") / FAN).cast("bigint").alias("idx")) \
            .agg(F.transform(kids, lambda x: x["digest"]).alias("children")) \
            .select("part", "h", "idx", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        out.append(save(level, f"{name}-{k}"))
        nodes = out[-1].select("part", "h", F.col("idx").alias("rank"), "digest")
    return out


def build(rows: DataFrame, group: str, order: str, leaf: str, keep: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows``; ``leaf`` names the digest column (see ``leaf_digest``), ``keep`` further columns
    that proofs shall carry."""
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    dealt, counts = _ranked(rows.select(F.col(group).alias("g"), F.col(order).alias("k"), F.col(leaf).alias("leaf"), *kept),
                            "g", ["k", "leaf"], "merkle")
    before = Window.partitionBy("g").orderBy("_task")
    counts = counts.withColumn("_off", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("_size", F.sum("_n").over(Window.partitionBy("g")))          # a row for each group and task
    # The groups in order get numbers, which stand for them (nulls included) from here on.
    names, per_task = _ranked(counts.select("g").distinct(), None, ["g"], "merkle-groups")
    shift = per_task.withColumn("_off", F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
    groups = save(names.join(shift, "_task").select(
        (F.coalesce("_off", F.lit(0)) + F.col("_at") - F.col("_first")).cast("bigint").alias("part"), "g"), "merkle-parts")
    place = save(counts.join(groups, counts["g"].eqNullSafe(groups["g"])).select(
        F.col("_task").alias("t"), "part", height(F.col("_size")).alias("h"), counts["g"].alias("pg"),
        (F.coalesce("_off", F.lit(0)) - F.col("_first")).alias("_shift")), "merkle-place")
    leaves = save(dealt.join(place, (F.col("_task") == F.col("t")) & F.col("g").eqNullSafe(F.col("pg"))).select(
        "part", "h", (F.col("_at") + F.col("_shift")).cast("bigint").alias("rank"), "leaf",
        *[f"keep_{c}" for c in keep]), "merkle-leaves")
    tree = Tree(leaves, _levels(leaves, "merkle-level"))
    tops = save(tree.tops(), "merkle-tops")
    n = tops.count()
    upper = tops.select(F.lit(0).cast("bigint").alias("part"), height(F.lit(n)).alias("h"), F.col("part").alias("rank"),
                        F.col("digest").alias("leaf"), F.col("h").alias("of_h"))
    top = Tree(upper, _levels(upper, "merkle-top"))
    root = top.tops().first()
    return Manifest(group, groups.withColumnRenamed("g", group), tree, top, root["digest"] if root else None)


def _step(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """Frontier rows with the children of their node, found by digest."""
    records = level.select("digest", "children").dropDuplicates(["digest"])
    return frontier.join(records, "digest")


def _siblings(children: Column, digit: Column) -> Column:
    """The unselected children, left and right of the selected one."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("l"),
                    F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("r"))


def _descend(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """One level down: a row for each child, its path one segment longer."""
    rest = [c for c in frontier.columns if c not in ("digest", "idx", "path")]
    wide = _step(frontier, level).select("*", F.posexplode("children").alias("digit", "child"))
    return wide.select(*rest, (F.col("idx") * FAN + F.col("digit")).cast("bigint").alias("idx"),
                       F.col("child").alias("digest"),
                       F.concat("path", F.array(_siblings(F.col("children"), F.col("digit")))).alias("path"))


def prove(manifest: Manifest, wanted: Column | None = None) -> DataFrame:
    """(part, rank, leaf, kept columns, subroot, root, path) of every leaf, or of those where ``wanted`` (over
    part, rank, leaf and the kept columns as ``keep_<name>``) holds. ``path`` has the siblings left and right of each node from the leaf up."""
    tree, top = manifest.tree, manifest.top
    spark = tree.leaves.sparkSession
    asked = tree.leaves if wanted is None else save(tree.leaves.filter(wanted), "merkle-wanted")

    def needed(frontier: DataFrame, k: int) -> DataFrame:
        """Nodes of level k above a wanted leaf."""
        if wanted is None:
            return frontier
        some = asked.select("part", F.floor(F.col("rank") / FAN ** k).cast("bigint").alias("idx")).distinct()
        return frontier.join(some, ["part", "idx"], "left_semi")

    cur = spark.createDataFrame([(manifest.root, 0)] if manifest.root else [], "digest string, idx long") \
        .withColumn("path", F.array().cast(PATH))
    for level in reversed(top.levels):
        cur = _descend(cur, level)
    parts = top.leaves.select(F.col("rank").alias("part"), F.col("of_h").alias("h"))
    arrived = save(cur.withColumnRenamed("idx", "part").join(parts, "part").select(
        "part", "h", F.lit(0).cast("bigint").alias("idx"), "digest", F.col("digest").alias("subroot"), "path"), "merkle-arrived")
    cur = None
    for k in range(len(tree.levels), 0, -1):
        here = arrived.filter(F.col("h") == k)
        cur = needed(here if cur is None else cur.unionByName(here), k)
        if k > 1:
            cur = save(_descend(cur, tree.levels[k - 1]), "merkle-frontier")     # a row for each node of the level below
    lone = needed(arrived.filter("h = 0"), 0).withColumn("children", F.lit(None).cast("array<string>"))
    last = lone if cur is None else _step(cur, tree.levels[0]).unionByName(lone)
    last = last.select(F.col("part").alias("p"), "idx", "subroot", "path", "children")
    digit = (F.col("rank") % FAN).cast("int")
    kept = [F.col(c).alias(c[5:]) for c in tree.leaves.columns if c.startswith("keep_")]
    met = asked.withColumn("up", F.floor(F.col("rank") / FAN).cast("bigint")) \
        .join(last, (F.col("part") == F.col("p")) & (F.col("up") == F.col("idx"))) \
        .select("part", "rank", "leaf", *kept, "subroot", F.lit(manifest.root).alias("root"),
                F.when(F.col("h") == 0, F.col("path")).otherwise(
                    F.concat("path", F.array(_siblings(F.col("children"), digit)))).alias("path"))
    return met.withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))
