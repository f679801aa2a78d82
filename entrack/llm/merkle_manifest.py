"""Merkle manifest of a table, with proofs by coordinate lookup.

Every row is a leaf digest; leaves form one tree per group, the trees' roots form one more. Leaves are numbered by
ranges of their order. Nodes are made block by block (64 leaves or less of one tree, six binary levels in one grouping)
and written as a table of (tree, level, place, digest); the blocks' tops are the leaves of the next tier. For a proof
each leaf explodes the coordinates of its siblings, which follow from its place, the group size and the tree's size, inside
its block; they are joined with the node table, put in order, and followed by the path of the block's top, which all leaves
of the block share. So no node is looked up by more leaves than a block has, and a tree's upper levels are looked up
once a block. A path is folded over a leaf's digest to give the root again.

Defined cases: a null field counts as ``-``; a null group is a tree of its own, the first; null ids come first; rows with
one id are ordered by digest, and rows that are alike in all are leaves of their own, each with the proof of its place;
a lone leaf is its tree's root and a lone tree's root the root, with no siblings (the digest of the empty text); an
empty table gives an empty result. Texts are digested whole, whatever their length. Columns beyond the fields change
nothing and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, crc_mod, table
from entrack.llm.places import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most leaves of a block.
BLOCK = 64
_PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by))


def _ceil_div(value: Column, by: int) -> Column:
    return _div(value + F.lit(by - 1), by)


@dataclass(frozen=True)
class Shape:
    """Group size of the trees, and how many levels a block has."""

    arity: int = 2

    @property
    def height(self) -> int:
        levels = 1
        while self.arity ** (levels + 1) <= BLOCK:
            levels += 1
        return levels

    @property
    def span(self) -> int:
        return self.arity**self.height

    def climb(self, of: Column) -> Column:
        """Levels from a tier's nodes to their block's top: fewer where the tree ends inside the block."""
        return sum((F.lit(self.arity**k) < of).cast("int") for k in range(self.height))

    def tiers(self, most: int) -> int:
        n = 0
        while self.span**n < most:
            n += 1
        return n


def _nodes(rows: DataFrame, shape: Shape) -> DataFrame:
    """(tree, level, place, of, h, top): all nodes of the blocks over ``rows``, which are level 0."""
    blocks = rows.groupBy("tree", "of", _div(F.col("place"), shape.span).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("base"))

    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / shape.arity).cast("int") - 1)
        return F.transform(runs, lambda j: F.sha2(F.concat_ws("", F.slice(below, j * shape.arity + 1, shape.arity)), 256))

    steps = F.filter(F.array(*[F.lit(k) for k in range(shape.height)]), lambda k: k < shape.climb(F.col("of")))
    base = F.array(F.transform("base", lambda x: x["h"]))
    levels = F.aggregate(steps, base, lambda found, _: F.concat(found, F.array(up(F.element_at(found, -1)))))
    by_level = blocks.select("tree", "of", "block", F.posexplode(levels).alias("level", "row"))
    wide = F.element_at(F.array(*[F.lit(shape.span // shape.arity**k) for k in range(shape.height + 1)]), F.col("level") + 1)
    every = by_level.select("tree", "of", "level", (F.col("block") * wide).alias("first"), F.posexplode("row").alias("j", "h"))
    return every.select("tree", "level", (F.col("first") + F.col("j")).alias("place"), "of", "h", (F.col("level") == shape.climb(F.col("of"))).alias("top"))


def _paths(rows: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    """Adds ``path`` to rows of (tree, place, of): the digests beside it, level by level, up to its block's top."""
    a, at, of = shape.arity, F.col("place"), F.col("of")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), _div(at, a**k).alias("own"), _ceil_div(of, a**k).alias("n")) for k in range(shape.height)])
    steps = rows.select("tree", "place", "of", F.inline(levels)).where(F.col("level") < shape.climb(of))
    first = _div(F.col("own"), a) * a
    run = F.sequence(first, F.least(first + (a - 1), F.col("n") - 1))
    asked = steps.select("tree", F.col("place").alias("leaf_place"), "level", "own", F.explode(run).alias("place")).where("place <> own")
    beside = asked.join(nodes.select("tree", "level", "place", "h"), ["tree", "level", "place"])
    kept = F.array_sort(F.collect_list(F.struct("level", "place", (F.col("place") < F.col("own")).alias("left"), "h")))
    found = beside.groupBy("tree", F.col("leaf_place").alias("place")).agg(kept.alias("found"))

    def side(level: Column, left: bool) -> Column:
        return F.concat_ws("", F.transform(F.filter("found", lambda x: (x["level"] == level) & (x["left"] == F.lit(left))), lambda x: x["h"]))

    steps = F.filter(F.array(*[F.lit(k) for k in range(shape.height)]), lambda k: k < shape.climb(of))
    path = F.transform(steps, lambda k: F.struct(side(k, True).alias("before"), side(k, False).alias("after")))
    return rows.join(found, ["tree", "place"], "left").withColumn("path", path).drop("found")


@dataclass(frozen=True)
class Forest:
    """Trees over placed leaves. ``inputs[t]``: the nodes that tier t begins with; ``nodes[t]``: those it made."""

    inputs: list[DataFrame]
    nodes: list[DataFrame]
    shape: Shape
    scratch: Scratch
    name: str

    def roots(self) -> DataFrame:
        """(tree, h) of every tree."""
        ends = [rows.where("of = 1").select("tree", "h") for rows in self.inputs]
        found = ends[0]
        for more in ends[1:]:
            found = found.unionByName(more)
        return found

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path`` and the other columns of ``above``: (tree, path, ...) of each tree's root."""
        carried = [c for c in above.columns if c != "tree"]
        found = None
        for t in range(len(self.inputs) - 1, -1, -1):
            rows = self.inputs[t]
            ended = rows.where("of = 1").join(above, "tree")
            if found is not None:
                tops = found.select("tree", F.col("place").alias("block"), F.col("path").alias("upper"), *[c for c in carried if c != "path"])
                own = _paths(rows.where("of > 1"), self.nodes[t], self.shape).withColumn("block", _div(F.col("place"), self.shape.span))
                ended = ended.unionByName(own.join(tops, ["tree", "block"]).withColumn("path", F.concat("path", "upper")).drop("block", "upper"))
            found = self.scratch.save(ended, f"{self.name}-paths-{t}") if t else ended
        return found


def forest(leaves: DataFrame, shape: Shape, scratch: Scratch, name: str) -> Forest:
    """Trees over leaves with the columns tree, place, of and h; others stay on the leaves."""
    most = leaves.agg(F.max("of")).first()[0] or 0
    inputs, made = [leaves], []
    for t in range(shape.tiers(most)):
        rows = inputs[-1].where("of > 1").select("tree", "place", "of", "h")
        nodes = scratch.save(_nodes(rows, shape), f"{name}-nodes-{t}")
        made.append(nodes)
        inputs.append(nodes.where("top").select("tree", "place", _ceil_div(F.col("of"), shape.span).alias("of"), "h"))
    return Forest(inputs, made, shape, scratch, name)


def manifest(docs: DataFrame, offered: dict[str, Column] | None = None, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", arity: int = 2) -> DataFrame:
    """Every row's leaf, root and proof, and the root that its offered form folds to.

    ``offered``: fields as another party hands them in, where ``changed`` holds; elsewhere the row itself is offered.
    Columns: the order column and the group, ``place``, ``leaf``, ``subroot``, ``root``, ``path`` (per level the digests
    before and after), ``folded_root`` and ``verified``.
    """
    shape, scratch = Shape(arity), Scratch(docs.sparkSession, "manifest")
    other = digest(*[field((offered or {}).get(c, F.col(c))) for c in fields])
    offered_leaf = F.when(F.coalesce(changed, F.lit(False)), other) if changed is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null, as '', before all others
    rows = docs.select(F.col(order).alias("key"), F.col(group).alias("grp"), tree.alias("tree"), digest(*[field(F.col(c)) for c in fields]).alias("h"), offered_leaf.alias("offered"))
    leaves = scratch.save(rows, "leaves")
    leaves = scratch.save(placed(leaves, "tree", ["key", "h"], scratch, "ranges"), "placed")
    scratch.drop("leaves", "ranges")
    trees = forest(leaves, shape, scratch, "trees")
    roots = scratch.save(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("member"), "h"), "roots")
    roots = scratch.save(placed(roots, "tree", ["member"], scratch, "root-ranges"), "roots-placed")
    upper = forest(roots, shape, scratch, "upper")
    top = upper.roots().select("tree", F.lit(None).cast(_PATH).alias("path"), F.col("h").alias("root")).withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    above = upper.proofs(top).select(F.col("member").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    found = trees.proofs(scratch.save(above, "above"))
    folded = F.aggregate("path", F.coalesce("offered", "h"), lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))
    out = found.select(F.col("key").alias(order), F.col("grp").alias(group), "place", F.col("h").alias("leaf"), "subroot", "root", "path", folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def siblings_digest(path: Column) -> Column:
    """One digest of a path's siblings from the leaf up, each run's from left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"]))), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"n_chars": F.col("n_chars") + 1}
    found = manifest(table(spark, sf_dir, "documents"), tampered, crc_mod(F.col("doc_id"), 7) == 0)
    return found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


#: The checksum of a decimal text, byte by byte and bit by bit, as DuckDB has none.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_LEAF = "sha256(concat({}))".format(", ".join("coalesce(concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)), '-')".format(c) for c in FIELDS))
ORACLE_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_LEAF} AS leaf,
         {_LEAF.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + 1 AS VARCHAR)")} AS other,
         coalesce({_CRC} % 7 = 0, false) AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows_
), nodes AS (
  SELECT tree, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 2, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 2, n
), steps AS (
  SELECT doc_id, tree, leaf, i AS place, 0 AS lvl, i, n, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS beside FROM leaves
  UNION ALL
  SELECT s.doc_id, s.tree, s.leaf, s.place, s.lvl + 1, s.i // 2, (s.n + 1) // 2,
         sha256(CASE WHEN s.i % 2 = 0 THEN s.h || coalesce(b.h, '') ELSE b.h || s.h END), s.beside || coalesce(b.h, '')
  FROM steps s LEFT JOIN nodes b ON b.tree = s.tree AND b.lvl = s.lvl AND b.i = xor(s.i, 1)
  WHERE s.n > 1
), last AS (
  SELECT s.doc_id, s.leaf, t.h AS subroot, 0 AS lvl, t.i, t.n, s.h, s.beside FROM steps s JOIN subroots t USING (tree) WHERE s.n = 1
), folds AS (
  SELECT * FROM last
  UNION ALL
  SELECT s.doc_id, s.leaf, s.subroot, s.lvl + 1, s.i // 2, (s.n + 1) // 2,
         sha256(CASE WHEN s.i % 2 = 0 THEN s.h || coalesce(b.h, '') ELSE b.h || s.h END), s.beside || coalesce(b.h, '')
  FROM folds s LEFT JOIN upper b ON b.lvl = s.lvl AND b.i = xor(s.i, 1)
  WHERE s.n > 1
)
SELECT f.doc_id, f.leaf, f.subroot, u.h AS root, sha256(f.beside) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM folds f JOIN upper u ON u.n = 1 WHERE f.n = 1
"""
