"""A Merkle manifest of a dataset, and every leaf's proof by pointer jumping.

Each row is a leaf; leaves form one tree per key, in the order of their ids, and the trees' roots
form the top tree. A run of up to eight consecutive nodes becomes one node. Levels are built by
grouping positions, so a level is an eighth of the one below.

Proofs: a node holds a segment, the siblings on the way to its ancestor, at first those of its own
run. Joining the table of nodes with itself doubles the distance to the ancestor and concatenates
the segments, so after a logarithm of the height every node holds its way to the root. The leaves
of a run share what lies above it, so a run, not a leaf, is what jumps; each leaf then adds its
siblings in the run. Ancestors of many nodes are few: while they are below a checked number they
are broadcast, beyond it no ancestor has more than a small share of the rows.

Nulls are written as `-`; a null key is a tree of its own, before all others; a null id comes first
in its tree. Rows of equal id follow in the order of their digests, so repeated rows are leaves of
their own. An empty table has no root. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import range_chunks, rank_overall, running_total
from tallyloom.session import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
#: Ancestors that are broadcast: so many rows of a segment each.
FEW = 4096
#: The top tree's key; trees of rows are "" for a null key or "=" and the key.
TOP = "^"
_AT = ["tree", "level", "pos"]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(column: str) -> Column:
    return F.translate(F.col(column), _UP, _LOW)


def leaf_digest(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The digest of a row: per field its UTF-8 length, a colon and its value, or `-` for null."""
    parts = []
    for name in fields:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return hashed(*parts)


@dataclass
class Manifest:
    """`runs` by tree, level and position with their children; `lone` leaves that are whole trees.

    `root` is None for an empty table. `height` is the longest way of a run to the root.
    """

    runs: DataFrame
    top: DataFrame
    lone: DataFrame
    root: str | None
    height: int


def _ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes that are alone in their tree, nodes of the other trees); at most one row a tree is joined."""
    more = nodes.where("pos = 1").select(F.col("tree").alias("_tree"))
    heads = nodes.where("pos = 0").join(more, F.col("tree") == F.col("_tree"), "left")
    alone = heads.where("_tree IS NULL").drop("_tree")
    return alone, nodes.where("pos > 0").unionByName(heads.where("_tree IS NOT NULL").drop("_tree"))


def _grow(leaves: DataFrame, child: Column) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(lone leaves, runs of each level, roots of trees with runs) of `tree, pos` and the columns of `child`."""
    lone, left = _ends(leaves)
    lone, levels, roots = durable(lone, "lone"), [], None
    level = 0
    while not left.isEmpty():
        level += 1
        members = F.sort_array(F.collect_list(child if level == 1 else F.struct("pos", "digest")))
        group = left.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("run")).agg(members.alias("children"))
        digest = hashed(F.array_join(F.col("children.digest"), ""))
        runs = durable(group.select("tree", F.lit(level).alias("level"), F.col("run").alias("pos"), digest.alias("digest"), "children"), "runs")
        levels.append(runs)
        ends, left = _ends(runs.select("tree", "level", "pos", "digest"))
        roots = ends if roots is None else roots.unionByName(ends)
    return lone, levels, roots


def build(docs: DataFrame, key: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, **extra: Column) -> Manifest:
    """The manifest of `docs`; `extra` columns travel with the leaves."""
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(order).alias("id"), leaf_digest(fields).alias("digest"), *[c.alias(n) for n, c in extra.items()])
    by = ["tree", "id", "digest"]
    placed = running_total(range_chunks(rows, by, "_range"), ["tree"], by, {"pos": F.lit(1)}, "_range").drop("_range")
    placed = durable(placed.withColumn("pos", F.col("pos") - 1), "leaves")
    lone, levels, roots = _grow(placed, F.struct("pos", "digest", "id", *extra))
    subroots = lone.select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"), "digest")
    subroots = durable(subroots if roots is None else subroots.unionByName(roots), "subroots")
    ranked = rank_overall(subroots.select(F.struct(*_AT).alias("of"), "digest", F.col("tree").alias("_at")), ["_at"], "pos")
    above = ranked.select(F.lit(TOP).alias("tree"), (F.col("pos") - 1).alias("pos"), "digest", "of")
    single, tops, crown = _grow(above, F.struct("pos", "digest", "of"))
    found = (single if crown is None else single.select("digest").unionByName(crown.select("digest"))).select("digest").first()
    shape = "tree string, level int, pos long, digest string, children array<struct<pos: long, digest: string"
    joined = spark.createDataFrame([], f"{shape}>>")
    for runs in [*levels[1:], *tops[1:]]:
        joined = joined.unionByName(runs)
    home = levels[0] if levels else None
    if home is None:
        kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in ("id", *extra))
        home = spark.createDataFrame([], f"{shape}, {kinds}>>")
    return Manifest(
        runs=joined, top=tops[0] if tops else None, lone=_as_runs(lone, home),
        root=found.digest if found else None, height=len(levels) + len(tops),
    )


def _as_runs(lone: DataFrame, home: DataFrame) -> DataFrame:
    """All that holds leaves: runs of the first level, and lone leaves as runs of level 0."""
    kind = home.schema["children"].dataType
    fields = [F.col(f.name) for f in kind.elementType.fields]
    alone = lone.select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"), "digest", F.array(F.struct(*fields)).cast(kind).alias("children"))
    return home.unionByName(alone)


def _digests(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def _step(children: str, at: str) -> Column:
    """The siblings before and after the child at a place of its run, as hex text."""
    run = F.col(children)
    left = _digests(F.slice(run, F.lit(1), F.col(at)))
    right = _digests(F.slice(run, F.col(at) + 2, F.lit(FANOUT)))
    return F.struct(left.alias("left"), right.alias("right"))


def links(manifest: Manifest, few: int = FEW) -> DataFrame:
    """Per run `tree, level, pos` its whole way: `way` array of (left, right), `subroot` where it passes one."""
    none = F.lit(None).cast("string")
    # children of the first level are leaves, which do not jump; those above are runs of the level below
    inner = manifest.runs.where("level > 1").select(*_AT, "children", F.posexplode("children").alias("at", "child")).select(
        F.struct("tree", (F.col("level") - 1).alias("level"), F.col("child.pos").alias("pos")).alias("of"),
        F.struct(*_AT).alias("to"), F.array(_step("children", "at")).alias("way"), none.alias("subroot"),
    )
    table = inner
    if manifest.top is not None:
        table = inner.unionByName(manifest.top.select(*_AT, "children", F.posexplode("children").alias("at", "child")).select(
            F.col("child.of").alias("of"), F.struct(*_AT).alias("to"), F.array(_step("children", "at")).alias("way"), F.col("child.digest").alias("subroot"),
        ))
    table = durable(table, "links")
    far = 1
    while far < manifest.height:
        # an ancestor lies at least `far` levels above the first, or in the top tree
        high = table.where((F.col("of.level") > far) | (F.col("of.tree") == TOP))
        ahead = high.select(F.col("of").alias("_of"), F.col("to").alias("_to"), F.col("way").alias("_way"), F.col("subroot").alias("_sub"))
        if high.count() <= few:
            ahead = F.broadcast(ahead)
        table = durable(table.join(ahead, F.col("to") == F.col("_of"), "left").select(
            "of", F.coalesce("_to", "to").alias("to"),
            F.when(F.col("_way").isNull(), F.col("way")).otherwise(F.concat("way", "_way")).alias("way"),
            F.coalesce("subroot", "_sub").alias("subroot"),
        ), "links")
        far *= 2
    return table


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to."""
    return F.aggregate(way, leaf, lambda node, step: hashed(step["left"], node, step["right"]))


def proofs(manifest: Manifest, few: int = FEW) -> DataFrame:
    """Per leaf `id, digest, subroot, way` and its extra columns; `way` goes from the leaf to the root."""
    ways = links(manifest, few).select("of", F.col("way").alias("_above"), "subroot")
    runs = manifest.lone.select(F.struct(*_AT).alias("of"), F.col("level").alias("_level"), "children")
    joined = runs.join(ways, "of", "left").select("_level", "children", "_above", "subroot", F.posexplode("children").alias("_at", "_leaf"))
    none = F.array().cast("array<struct<left: string, right: string>>")
    own = F.when(F.col("_level") == 1, F.array(_step("children", "_at"))).otherwise(none)
    return joined.select(
        "_leaf.*", F.coalesce("subroot", F.lit(manifest.root)).alias("subroot"),
        F.concat(own, F.coalesce("_above", none)).alias("way"),
    )
