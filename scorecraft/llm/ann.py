"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A unit vector is turned by a fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and assigned to the nearest signed axis; a table's key joins the axes of
a few such rotations.  A query looks into the keys that its neighbours have most likely, and
the candidates found are reranked by their exact Euclidean distance to it.

There are ``KEYS`` times as many keys as vectors, so keys lengthen with the table and a key holds
no more of a larger one.  How many keys are looked up is fitted on a bounded sample of vectors,
searched exactly, for a recall of ``RECALL``; a query whose neighbours are near takes fewer.

Equal vectors are searched once: they form a class that keeps the few ids that a result can
name, picked before the shuffle, so a vector that a third of all rows share costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm.store import stored, table

#: Queries that one exact scan holds in memory.
SCAN_QUERIES = 1024
#: Values that a numpy step handles at once.
STEP = 1 << 22
#: Keys of two axes looked up in each table by a plan that is not fitted.
PROBES = 144
#: Tables of a fitted plan, and its keys for each vector.
TABLES = 512
KEYS = 3
#: Keys of a table that a query of a fitted plan looks up at most.
EACH = 96
#: Vectors that a plan is fitted on, and the share of their neighbours that it must find.
SAMPLE = 512
RECALL = 0.99
#: Tables in which a query's own keys are looked up first, to learn how near its neighbours are.
FIRST = 16
#: Queries whose likeliest keys are found at once, and by one task.
ROWS = 32
TASK = 64
#: The widest pseudo-rotation that is kept as a matrix.
KEPT = 128


@dataclass(frozen=True)
class Plan:
    """``tables`` tables with keys of ``polytopes`` axes; ``probes`` keys looked up in each.

    The last polytope has the first ``last`` coordinates only (0: all).  A plan with ``hits``
    is fitted: a query whose neighbours have the cosine ``cosine`` or more looks up its likeliest
    keys over all tables, until their probabilities add up to ``hits``.
    """

    dim: int
    tables: int
    polytopes: int
    probes: int
    last: int = 0
    cosine: float = 0.0
    hits: float = 0.0

    @staticmethod
    def for_rows(rows: int, dim: int) -> Plan:
        """A plan that is not fitted: keys of two axes from 4 096 rows, as many at every size.

        The share of the keys that a query looks up, and so of the rows that it is compared
        with (about a quarter), does not fall as the table grows: recall stays, and the pairs
        grow with rows times queries.
        """
        if rows < 4096:
            return Plan(dim, 32, 1, 8)
        return Plan(dim, 32, 2, PROBES)

    @staticmethod
    def of_keys(rows: int, dim: int) -> Plan:
        """A plan to be fitted: the fewest keys that are ``KEYS`` for each row, or more."""
        plan, keys = Plan(dim, TABLES, 0, EACH), 1
        while keys * 2 * plan.width <= KEYS * rows:
            keys, plan = keys * 2 * plan.width, replace(plan, polytopes=plan.polytopes + 1)
        last = 1
        while keys * 2 * last < KEYS * rows:
            last *= 2
        return replace(plan, polytopes=plan.polytopes + 1, last=last)

    def axes(self, polytope: int) -> int:
        """Coordinates of a polytope; it has twice as many signed axes."""
        return self.last if self.last and polytope == self.polytopes - 1 else self.width

    @property
    def keys(self) -> int:
        """How many keys a table has."""
        return int(np.prod([2 * self.axes(j) for j in range(self.polytopes)], dtype=object))

    @property
    def width(self) -> int:
        """The dimension padded to a power of two."""
        return 1 << max(1, (self.dim - 1).bit_length())


def rotate(x: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """A fast pseudo-rotation of the rows, the same for the same seed."""
    signs = np.random.default_rng(seed)
    n, width = x.shape
    for _ in range(3):
        x = x * signs.choice(np.array([-1.0, 1.0], np.float32), width)
        step = 1
        while step < width:
            y = x.reshape(n, -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
            step *= 2
        x = x / np.sqrt(np.float32(width))
    return x


def unit(vectors: np.ndarray, width: int) -> np.ndarray:
    """Rows brought to length 1 and padded with zeros."""
    out = np.zeros((len(vectors), width), np.float32)
    out[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return out


@lru_cache(maxsize=4096)
def rotation(width: int, seed: tuple[int, int]) -> np.ndarray:
    """The pseudo-rotation of a seed as a matrix, turned once for the rows of all batches."""
    return rotate(np.eye(width, dtype=np.float32), seed)


def turned(x: np.ndarray, plan: Plan, number: int, polytope: int) -> np.ndarray:
    """The rows' coordinates in one polytope of a table."""
    seed = (number, polytope)
    axes = plan.axes(polytope)
    return x @ rotation(plan.width, seed)[:, :axes] if plan.width <= KEPT else rotate(x, seed)[:, :axes]


def bucket_keys(x: np.ndarray, plan: Plan, number: int) -> np.ndarray:
    """The key of every row in one table."""
    key = np.zeros(len(x), np.int64)
    for j in range(plan.polytopes):
        y = turned(x, plan, number, j)
        axis = np.abs(y).argmax(1)
        negative = np.take_along_axis(y, axis[:, None], 1)[:, 0] < 0
        key = key * (2 * plan.axes(j)) + axis + plan.axes(j) * negative
    return key


def probe_keys(x: np.ndarray, plan: Plan, number: int, near: int = 24) -> np.ndarray:
    """The keys nearest to every row in one table, nearest first.

    A key's cost is the sum over its axes of the squared distance to the largest coordinate;
    the cheapest combinations are built from the ``near`` best axes of each polytope.
    """
    keys = costs = None
    for j in range(plan.polytopes):
        y = turned(x, plan, number, j)
        signed = np.concatenate([y, -y], 1)
        cost = (signed.max(1, keepdims=True) - signed) ** 2
        axis = np.argsort(cost, 1)[:, :near]
        cost = np.take_along_axis(cost, axis, 1)
        if keys is None:
            keys, costs = axis.astype(np.int64), cost
            continue
        keys = (keys[:, :, None] * (2 * plan.axes(j)) + axis[:, None, :]).reshape(len(x), -1)
        costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
        best = np.argsort(costs, 1, kind="stable")[:, : plan.probes]
        keys = np.take_along_axis(keys, best, 1)
        costs = np.take_along_axis(costs, best, 1)
    return keys[:, : plan.probes]


def likely_keys(
    x: np.ndarray, cosine: np.ndarray, plan: Plan, near: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    """Every row's likeliest keys over all tables, likeliest first, and what those before add up to.

    ``cosine`` is that of a row's farthest neighbour sought.  The neighbour's coordinates are the
    row's times the cosine, with about normal noise; the largest of many such is nearly Gumbel, so
    an axis has a softmax's probability, and a key the product of its axes'.  Keys count on from
    table to table.
    """
    cosine = np.clip(cosine, 0.01, 0.98).astype(np.float32)
    sharp = cosine / np.sqrt(1 - cosine * cosine) * np.sqrt(np.float32(plan.width))
    keys, logs = [], []
    for number in range(plan.tables):
        key, log = np.full((len(x), 1), number, np.int64), np.zeros((len(x), 1), np.float32)
        for j in range(plan.polytopes):
            y = turned(x, plan, number, j)
            axes = 2 * plan.axes(j)
            y = np.concatenate([y, -y], 1) * (sharp * np.sqrt(2 * np.log(axes)))[:, None]
            y -= y.max(1, keepdims=True)
            y -= np.log(np.exp(y).sum(1, keepdims=True))
            axis = np.argsort(-y, 1)[:, :near]
            y = np.take_along_axis(y, axis, 1)
            key = (key[:, :, None] * axes + axis[:, None, :]).reshape(len(x), -1)
            log = (log[:, :, None] + y[:, None, :]).reshape(len(x), -1)
            if log.shape[1] > plan.probes:
                best = np.argpartition(-log, plan.probes - 1, 1)[:, : plan.probes]
                key, log = np.take_along_axis(key, best, 1), np.take_along_axis(log, best, 1)
        keys.append(key)
        logs.append(log)
    log = np.concatenate(logs, 1)
    order = np.argsort(-log, 1, kind="stable")
    chance = np.exp(np.take_along_axis(log, order, 1).astype(np.float64))
    return np.take_along_axis(np.concatenate(keys, 1), order, 1), np.cumsum(chance, 1) - chance


def table_keys(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The key of every row in every table, counted on from table to table."""
    return np.stack([number * plan.keys + bucket_keys(x, plan, number) for number in range(plan.tables)], 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has the dimension, only finite components, and one that is not 0."""
    finite = F.forall(
        vector,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))),
    )
    return F.coalesce(
        (F.size(vector) == dim) & finite & F.exists(vector, lambda v: v != 0), F.lit(False)
    )


def vector_classes(embeddings: DataFrame, dim: int, k: int) -> DataFrame:
    """``class_id, vector, members, most`` of every different usable vector.

    ``members`` are rows of its ``k + 1`` smallest ids, ``k`` of an id at most, and so all
    that a result of ``k`` can name whichever id asks; ``class_id`` is the smallest id, and
    ``most`` the most members of one id.  Rows of an id are counted map-side, and ids cut
    down per task, before the shuffle.  Vectors are told apart by two 64-bit hashes.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = (
        embeddings.select("vec_id", vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector"), dim))
        .select(
            "vec_id",
            "vector",
            F.xxhash64(F.lit(1), "vector").alias("k1"),
            F.xxhash64(F.lit(2), "vector").alias("k2"),
        )
    )
    ids = rows.groupBy("k1", "k2", "vec_id").agg(
        F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"),
        F.first("vector").alias("vector"),
    )
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = F.flatten(F.collect_list(F.expr("array_repeat(vec_id, copies)")))
    return (
        ids.withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= k + 1)
        .groupBy("k1", "k2")
        .agg(
            F.min("vec_id").alias("class_id"),
            F.min_by("vector", "vec_id").alias("vector"),
            F.sort_array(members).alias("members"),
            F.max("copies").alias("most"),
        )
        .select("class_id", "vector", "members", "most")
    )


def _hashed(classes: DataFrame, plan: Plan, probe: bool) -> DataFrame:
    """``id, key``: the buckets of every class, or the keys that it looks up.

    For the lookup of a fitted plan ``classes`` has ``cosine``, or null where none is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = probe and plan.hits
        rows = ROWS if fitted else max(1, STEP // (plan.width * 32))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column("class_id").to_numpy()
                x = unit(matrix(part.column("vector"), plan.dim), plan.width)
                if fitted:
                    cosine = part.column("cosine").fill_null(-1.0).to_numpy()
                    keys, before = likely_keys(x, np.maximum(cosine, plan.cosine), plan)
                    taken = before < plan.hits
                    columns = [np.repeat(ids, taken.sum(1)), keys[taken]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "key"])
                    continue
                for number in range(plan.tables):
                    if probe:
                        keys = probe_keys(x, plan, number)
                    else:
                        keys = bucket_keys(x, plan, number)[:, None]
                    columns = [np.repeat(ids, keys.shape[1]), (keys + number * plan.keys).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "key"])

    columns = [c for c in ("class_id", "vector", "cosine") if c in classes.columns]
    return classes.select(*columns).mapInArrow(run, "id long, key long")


def _scored(probes: DataFrame, asked: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """``query, found, distance, cosine`` of the classes in the buckets that ``probes`` look up."""
    buckets = _hashed(classes, plan, probe=False).withColumnRenamed("id", "found")
    # all tables' hits of a pair come together here, before any vector is moved
    hits = probes.withColumnRenamed("id", "query").join(buckets, "key")
    pairs = hits.select("query", "found").distinct()
    left = asked.select(F.col("class_id").alias("query"), F.col("vector").alias("a"))
    right = classes.select(F.col("class_id").alias("found"), F.col("vector").alias("b"))
    return _distances(pairs.join(left, "query").join(right, "found"), plan.dim)


def _needed(told: DataFrame, plan: Plan) -> DataFrame:
    """``needed``: the ``hits`` that a plan must exceed to find a neighbour, of every one told.

    Infinite for one that none of the keys finds that a query may look up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = unit(matrix(part.column("vector"), plan.dim), plan.width)
                cosine = part.column("cosine").fill_null(-1.0).to_numpy()
                found = likely_keys(x, np.maximum(cosine, plan.cosine), plan)
                for keys, before, near in zip(*found, part.column("near"), strict=True):
                    near = matrix(pa.array([near.as_py()]), plan.dim)
                    order, own = np.argsort(keys), table_keys(unit(near, plan.width), plan)
                    at = order[np.minimum(np.searchsorted(keys, own, sorter=order), len(order) - 1)]
                    least = np.where(keys[at] == own, before[at], np.inf).min(1)
                    yield pa.RecordBatch.from_arrays([pa.array(least)], ["needed"])

    return told.select("vector", "cosine", "near").mapInArrow(run, "needed double")


def _distances(pairs: DataFrame, dim: int) -> DataFrame:
    """``query, found, distance, cosine`` from pairs with both vectors, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column("a"), dim), matrix(batch.column("b"), dim)
            gap = a - b
            distance = np.sqrt((gap * gap).sum(1))
            lengths = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            cosine = ((a / lengths[0][:, None]) * (b / lengths[1][:, None])).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("found"), pa.array(distance), pa.array(cosine)],
                ["query", "found", "distance", "cosine"],
            )

    return pairs.select("query", "found", "a", "b").mapInArrow(
        run, "query long, found long, distance double, cosine double"
    )


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "found")
    return (
        scored.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .drop("nth")
    )


def _scanned(asked: DataFrame, classes: DataFrame, dim: int, k: int) -> DataFrame | None:
    """Exact nearest classes of the few queries whose buckets held too little.

    In blocks of ``SCAN_QUERIES`` query vectors, each against all classes; a task keeps the
    nearest ``k + 1`` of each batch for each query of the block.
    """
    names = [r.class_id for r in asked.select("class_id").orderBy("class_id").toLocalIterator()]
    out = None
    for start in range(0, len(names), SCAN_QUERIES):
        low, high = names[start], names[min(start + SCAN_QUERIES, len(names)) - 1]
        block = asked.where(F.col("class_id").between(low, high)).collect()
        ids = np.array([r.class_id for r in block], np.int64)
        vectors = np.array([r.vector for r in block], np.float64)

        def run(batches, ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column("class_id").to_numpy()
                x = matrix(batch.column("vector"), dim)
                for i, v in zip(ids, vectors, strict=True):
                    distance = np.sqrt(((x - v) ** 2).sum(1))
                    best = np.lexsort((found, distance))[: k + 1]
                    columns = [np.full(len(best), i), found[best], distance[best]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], ["query", "found", "distance"]
                    )

        part = classes.select("class_id", "vector").mapInArrow(
            run, "query long, found long, distance double"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _fitted(
    asked: DataFrame, classes: DataFrame, rows: int, dim: int, k: int
) -> tuple[Plan, DataFrame]:
    """A plan fitted on ``SAMPLE`` vectors, and ``asked`` with the ``cosine`` known of each.

    That cosine is the least of the ``k + 1`` nearest in the query's own buckets of ``FIRST``
    tables, null if they hold fewer: in a dense group a few keys find all, and as many as others
    need would meet every member in every table.  The plan has the least ``hits`` that find
    ``RECALL`` of the sample's neighbours; if no lookup finds as many, it is not fitted.
    """
    plan = Plan.of_keys(rows, dim)
    few = replace(plan, tables=FIRST)
    sample = stored(classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE))
    vectors = [t.select("class_id", "vector") for t in (asked, sample)]
    both = vectors[0].unionByName(vectors[1]).dropDuplicates(["class_id"])
    own = stored(_hashed(both, few, probe=False))
    first = _nearest(_scored(own, both, classes, few), k)
    known = first.groupBy("query").agg(F.min("cosine").alias("cosine"), F.count(F.lit(1)).alias("n"))
    known = stored(known.where(F.col("n") > k).select(F.col("query").alias("class_id"), "cosine"))
    asked = asked.join(known, "class_id", "left")

    exact = _scanned(sample, classes, dim, k)
    if exact is None:
        return Plan.for_rows(rows, dim), asked
    found = classes.select(F.col("class_id").alias("found"), F.col("vector").alias("v"))
    near = _nearest(exact, k).where("query <> found").join(found, "found")
    near = near.groupBy(F.col("query").alias("class_id")).agg(F.flatten(F.collect_list("v")).alias("near"))
    told = stored(sample.join(near, "class_id").join(known, "class_id", "left"))
    far = []
    for r in told.select("vector", "near").toLocalIterator():
        sides = [unit(np.array(v, np.float64).reshape(-1, dim), plan.width) for v in (r.vector, r.near)]
        far.append((sides[1] @ sides[0][0]).min())
    plan = replace(plan, cosine=float(np.median(far or [0.0])))
    needed = _needed(told.repartition(max(1, SAMPLE // TASK), "class_id"), plan)
    needed = np.array([r.needed for r in needed.collect()] or [0.0])
    least = np.quantile(needed, RECALL, method="higher")
    if not np.isfinite(least):
        return Plan.for_rows(rows, dim), asked
    return replace(plan, hits=float(least) + 1e-9), asked


def search(
    embeddings: DataFrame, queries: Column, k: int = 10, plan: Plan | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row.

    ``embeddings`` has ``vec_id`` and ``embedding``; ``queries`` chooses the query rows and
    all rows are candidates, but not those with the query's own id.  Nearest first, ties to
    the smaller id.  Null ids and vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part.  Rows that repeat an id are
    candidates of their own, and ask once.  A query whose buckets hold fewer than ``k``
    candidates is searched exactly.  Other columns are not read.  Without a ``plan`` one is
    fitted on a sample of the vectors.
    """
    dim = embeddings.where(F.size("embedding") > 0).agg(F.mode(F.size("embedding"), deterministic=True)).first()[0] or 1
    classes = stored(vector_classes(embeddings, dim, k))
    size = classes.agg(F.count(F.lit(1)), F.sum(F.size("members"))).first()
    vector = F.col("embedding").cast("array<double>")
    asking = (
        embeddings.where(queries & F.col("vec_id").isNotNull())
        .select("vec_id", vector.alias("vector"))
        .where(usable(F.col("vector"), dim))
        .select("vec_id", F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2"))
        .distinct()
    )
    keyed = classes.select(
        "class_id", F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2")
    )
    asking = stored(asking.join(keyed, ["k1", "k2"]).select("vec_id", "class_id"))
    asked = stored(classes.join(asking.select("class_id").distinct(), "class_id", "left_semi"))

    # every pair moves a vector: floats go as floats, which loses nothing
    given = embeddings.select("embedding").schema[0].dataType.simpleString()
    moved = F.col("vector").cast("array<float>" if given == "array<float>" else "array<double>")
    asked, classes = asked.withColumn("vector", moved), classes.withColumn("vector", moved)
    if plan is None:
        plan, asked = _fitted(asked, classes, size[0], dim, k)
    else:
        asked = asked.withColumn("cosine", F.lit(None).cast("double"))
    # written, so that Spark knows how large they are
    dealt = asked.repartition(1 + asked.count() // TASK, "class_id")
    probes = stored(_hashed(dealt, plan, probe=True))
    scored = _scored(probes, asked, classes, plan)
    members = classes.select(F.col("class_id").alias("found"), "members")
    nearest = stored(_nearest(scored.drop("cosine"), k).join(members, "found"))

    # as many as any one id of the class needs beside its own rows, or all there are
    wanted = F.least(F.col("most") + k, F.lit(size[1] or 0))
    held = (
        nearest.groupBy("query")
        .agg(F.sum(F.size("members")).alias("held"))
        .join(asked.select(F.col("class_id").alias("query"), "most"), "query")
        .where(F.col("held") >= wanted)
        .select("query", "held")
    )
    short = asked.join(held, asked["class_id"] == held["query"], "left_anti")
    exact = _scanned(short, classes, dim, k)
    if exact is not None:
        again = _nearest(exact, k).join(members, "found")
        enough = nearest.join(held.select("query"), "query", "left_semi")
        nearest = enough.unionByName(again.select(*enough.columns))

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = nearest.select("query", F.col("distance").alias("score"), F.explode("members").alias("vec_id"))
    return (
        asking.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query"))
        .join(found, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
