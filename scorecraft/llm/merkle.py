"""Merkle manifest of a dataset: leaves, subroots, one root, and a proof for every row.

1. Leaves are numbered within their tree (a language) by range partitions: numbers inside
   each partition, plus the rows of the tree in earlier ones.
2. A number is a block and digits to the base ``fan``.  Within a block the digit columns are
   grouped away one after another, the lowest first; every group becomes a struct that nests
   the structs of its children.  Rows of a block lie in one partition, so a block's groupings
   share one shuffle, and a nested row never holds more than ``fan ** digits`` leaves.
3. The blocks' digests are the nodes of the next tier, until every tree is one block; the
   trees' subroots are the leaves of one more tree.
4. Downwards a nested row meets the path above its block by one more grouping; a transform
   of the nested struct gives each child the siblings beside it, and an explode emits one
   proof a row.  No join, window or list covers a whole tree.

Digests are lower-case hex text of SHA-256.  A run that is not the only node of its level is
hashed even if it has one member; a lone leaf is its own subroot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm.store import stored, table

#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Shape:
    """Runs of ``fan`` nodes; blocks of ``fan ** digits``."""

    fan: int = 2
    digits: int = 8

    @property
    def block(self) -> int:
        return self.fan**self.digits


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    """The digest of a row; columns of ``FIELDS`` may be given in place of the row's own."""
    return digest(*[field(values.get(name, F.col(name))) for name in FIELDS])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, from 0 within each ``tree`` by ``order``, and ``n``, its rows.

    Rows are spread by range over (tree, order, number of the row in its input), so neither
    a large tree nor a repeated row is one task.  The numbered partitions are written, and
    only one row for each partition and tree in it is summed and joined back.
    """
    spread = rows.withColumn("given", F.monotonically_increasing_id())
    by = ["tree", *order, "given"]
    placed = stored(
        spread.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("given")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33))
    )
    tree = Window.partitionBy("tree")
    spans = stored(
        placed.groupBy("tree", "part")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
        .withColumn("n", F.sum("rows").over(tree))
        .withColumn("until", F.sum("rows").over(tree.orderBy("part")))
        .select(
            F.col("tree").alias("of"),
            F.col("part").alias("in"),
            "n",
            (F.col("until") - F.col("rows") - F.col("first")).alias("shift"),
        )
    )
    same = (F.col("part") == F.col("in")) & F.col("tree").eqNullSafe(F.col("of"))
    return (
        placed.join(spans, same)
        .withColumn("at", F.col("place") + F.col("shift"))
        .drop("place", "part", "of", "in", "shift")
    )


def blocks(nodes: DataFrame, shape: Shape) -> DataFrame:
    """``tree, n, block, node`` from ``tree, n, at, digest, item``: one nested row a block.

    ``node`` is a struct of the digest and the children, down to structs of digest and item.
    """
    digits = [f"d{i}" for i in range(shape.digits)]
    at = F.col("at")
    now = nodes.select(
        "tree",
        "n",
        F.floor(at / shape.block).alias("block"),
        *[(F.floor(at / shape.fan**i) % shape.fan).alias(d) for i, d in enumerate(digits)],
        F.struct("digest", "item").alias("node"),
    ).repartition("tree", "block")
    for i, digit in enumerate(digits):
        rest = ["tree", "n", "block", *digits[i + 1 :]]
        run = F.sort_array(F.collect_list(F.struct(digit, "node")))
        now = now.groupBy(*rest).agg(F.transform(run, lambda x: x["node"]).alias("kids"))
        joined = digest(F.array_join(F.transform("kids", lambda x: x["digest"]), ""))
        # a level of one node is the top of its tree already
        own = F.when(F.col("n") > shape.fan**i, joined).otherwise(F.col("kids")[0]["digest"])
        now = now.select(*rest, F.struct(own.alias("digest"), "kids").alias("node"))
    return now


def climb(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The tiers of blocks above ``nodes``, written; the last has one block for each tree."""
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(stored(blocks(nodes, shape)))
        most = -(-most // shape.block)
        if most <= 1:
            return tiers
        nodes = tiers[-1].select(
            "tree",
            F.ceil(F.col("n") / shape.block).alias("n"),
            F.col("block").alias("at"),
            F.col("node.digest").alias("digest"),
            F.lit(None).cast("string").alias("item"),
        )


def descend(tiers: list[DataFrame], above: DataFrame, shape: Shape) -> DataFrame:
    """``tree, at, digest, item, path, top`` of every node that was climbed from.

    ``above`` has ``tree, path, top``: a path that goes on from the tree's subroot, and what
    is handed down unchanged.  A path lists, level by level upwards, the node's place in its
    run and the digests of the others.
    """
    now = above.select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    for tier in reversed(tiers):
        met = (
            tier.unionByName(now, allowMissingColumns=True)
            .groupBy("tree", "block")
            .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "top")])
        )

        def proofs(node: Column, level: int, path: Column, at: Column) -> Column:
            if not level:
                return F.array(
                    F.struct(
                        at.alias("at"),
                        node["digest"].alias("digest"),
                        node["item"].alias("item"),
                        F.filter(path, lambda x: x.isNotNull()).alias("path"),
                    )
                )
            kids = node["kids"]

            def child(kid: Column, place: Column) -> Column:
                others = F.filter(kids, lambda _, j: j != place)
                step = F.struct(
                    place.alias("place"), F.transform(others, lambda x: x["digest"]).alias("others")
                )
                here = F.when(F.col("n") > shape.fan ** (level - 1), step)
                return proofs(kid, level - 1, F.concat(F.array(here), path), at * shape.fan + place)

            return F.flatten(F.transform(kids, child))

        every = proofs(F.col("node"), shape.digits, F.col("path"), F.col("block"))
        now = met.select("tree", "top", F.explode(every).alias("x")).select("tree", "top", "x.*")
        last, now = now, now.select("tree", F.col("at").alias("block"), "path", "top")
    return last


def manifest(documents: DataFrame, claimed: Column | None = None, shape: Shape | None = None) -> DataFrame:
    """``doc_id, lang, leaf, claimed, subroot, root, path`` of every row.

    Rows are the leaves, in one tree for each ``lang`` (null is one) by ascending ``doc_id``
    (null first), rows of one id by their digests; so equal rows differ in their path only.
    ``claimed`` is the leaf that a reader has found, where it may differ from the row's own.
    Columns besides ``FIELDS`` are not read; nulls, empty and very long texts are leaves like
    any.  An empty table has no rows and no root.
    """
    shape = shape or Shape()
    own = leaf()
    rows = documents.select(
        F.col("lang").alias("tree"),
        "doc_id",
        own.alias("digest"),
        (own if claimed is None else claimed).alias("claimed"),
    ).withColumn("claimed", F.nullif("claimed", "digest"))
    nodes = numbered(rows, "doc_id", "digest").withColumn("item", F.struct("doc_id", "claimed"))
    tiers = climb(nodes, shape)

    subroots = tiers[-1].select(
        F.lit(0).alias("tree"), F.col("tree").alias("lang"), F.col("node.digest").alias("digest")
    )
    trees = climb(
        numbered(subroots, "lang").withColumn("item", F.struct("lang")), shape
    )
    start = trees[-1].select(
        "tree",
        F.array().cast("array<struct<place:int,others:array<string>>>").alias("path"),
        F.col("node.digest").alias("top"),
    )
    above = descend(trees, start, shape).select(
        F.col("item.lang").alias("tree"),
        "path",
        F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"),
    )
    return descend(tiers, above, shape).select(
        "item.doc_id",
        F.col("tree").alias("lang"),
        F.col("digest").alias("leaf"),
        F.coalesce("item.claimed", "digest").alias("claimed"),
        "top.subroot",
        "top.root",
        "path",
    )


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def level(own: Column, step: Column) -> Column:
        others, place = step["others"], step["place"]
        left = F.array_join(F.slice(others, F.lit(1), place), "")
        right = F.array_join(F.slice(others, place + 1, F.size(others)), "")
        return digest(left, own, right)

    return F.aggregate(path, start, level)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda x: x["others"])), ""))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; ``n_chars`` is tampered with where 7 divides the id's crc32."""
    marked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = leaf(n_chars=F.when(marked, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    folded = fold(F.col("claimed"), F.col("path"))
    return (
        manifest(table(spark, sf_dir, "documents"), found)
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            proof_digest(F.col("path")).alias("proof_sha256"),
            folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


_LEAF = " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS
)
#: The remainder of a CRC-32 over the digits of the id, eight steps a byte.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"""

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         sha256({_LEAF.replace("n_chars", "changed")}) AS found
  FROM (SELECT *, n_chars + CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS changed
        FROM documents)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         coalesce('+' || lang, '') AS tree FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM ranked
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
  FROM tops WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT r.doc_id, r.leaf, r.tree, r.pos, s.level, CASE WHEN x.h IS NULL THEN 'N'
         WHEN x.pos < s.pos THEN 'L' || x.h ELSE 'R' || x.h END AS step
  FROM ranked r JOIN nodes s ON s.tree = r.tree AND s.n > 1 AND s.pos = r.pos >> s.level
  LEFT JOIN nodes x ON x.tree = s.tree AND x.level = s.level AND x.pos = xor(s.pos, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, r.tree, r.pos, 100 + s.level, CASE WHEN x.h IS NULL THEN 'N'
         WHEN x.pos < s.pos THEN 'L' || x.h ELSE 'R' || x.h END
  FROM ranked r JOIN subroots t ON t.tree = r.tree
  JOIN tops s ON s.n > 1 AND s.pos = t.pos >> s.level
  LEFT JOIN tops x ON x.level = s.level AND x.pos = xor(s.pos, 1)),
paths AS (SELECT tree, pos, list(step ORDER BY level) AS path FROM steps GROUP BY ALL),
folded AS (
  SELECT r.doc_id, r.leaf, r.tree,
         sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(r.found, coalesce(path, [])), lambda a, x:
           sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM ranked r LEFT JOIN paths p ON p.tree = r.tree AND p.pos = r.pos)
SELECT f.doc_id, f.leaf, t.subroot, root.h AS root, f.proof_sha256, f.folded_root,
       f.folded_root = root.h AS verified
FROM folded f JOIN subroots t USING (tree), (SELECT h FROM tops WHERE n = 1) root
"""
