"""N-gram Jaccard join by a token-group matrix: documents linked by similar shingle sets.

1. Shingles in many documents are counted, so that they come last in one order of shingles.
   By that order every set has a prefix so long that two similar sets share a shingle of
   their prefixes: a set that shares none has too small a bound on its overlap.
2. Equal sets become one class.  Classes whose minimum hashes collide are compared with the
   few of their bucket that collide most; verified links make components, and components
   about half as near to a larger one as the threshold asks join it in one group.
3. The token-group matrix has a row for each shingle and group: the union of its members'
   prefixes, with the range of their sizes.  A class meets the groups in the rows of its own
   prefix.  A group of one member is bounded by the shingles shared so far and those to come.
4. A group of several is met as blocks of its members.  The union of a block's whole sets
   bounds the overlap of a class with any of them; only where that reaches the threshold is
   the block opened, and its members are counted exactly.  Members of the same component
   are never compared, and a class has one link to each other component of a block.
5. Every comparison is exact, over whole sets; links join components to the result.

The result is exact whatever was counted in 1 or collided in 2; these decide the work only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm import text as tx
from scorecraft.llm.components import components
from scorecraft.llm.store import stored, table

#: Most shingles that are told apart as frequent; the least count that makes one so.
MOST_FREQUENT, LEAST_FREQUENT = 1 << 20, 8
#: Ids up to which a checked list of documents is broadcast instead of shuffling texts.
BROADCAST_IDS = 2_000_000
BANDS, BAND_ROWS = 8, 4
#: Classes of a bucket that its others are compared with to make groups.
CENTRES = 3
#: Shingles of a group's members, and of the classes that ask for it, in one block.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked from ``percent`` percent of the union in common."""

    words: int = 5
    percent: int = 80

    def needed(self, n):
        """The least overlap of a set of ``n`` with any set linked to it."""
        return -(-self.percent * n // 100)


def sets(array: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, in ascending order by document, their documents and numbers.

    Words are lower-cased in ASCII.  A text of fewer than ``k`` words has all its words as
    one shingle; one without words has none.
    """
    data, bounds = tx.flat(array)
    data = tx.LOWER[data]
    n = len(bounds) - 1
    starts, ends, owner = tx.words(data, bounds)
    word = tx.SpanHash(data)(starts, ends)
    hashes, documents = tx.shingles(word, owner, k)
    counts = np.bincount(owner, minlength=n)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        begin = np.searchsorted(owner, few)
        value = np.full(len(few), 0x5851F42D4C957F2D, np.uint64)
        for j in range(k - 1):
            more = j < counts[few]
            at = np.where(more, begin + j, 0)
            value = np.where(more, tx.mix(value * np.uint64(0xD6E8FEB86659FD93) + word[at]), value)
        hashes = np.concatenate([hashes, value])
        documents = np.concatenate([documents, few])
    order, first = tx.groups(hashes, documents)
    kept = order[first]
    hashes, documents = hashes[kept], documents[kept]
    return hashes, documents, np.bincount(documents, minlength=n)


def _count(documents: DataFrame, rule: Rule) -> DataFrame:
    """``token, n``: 32-bit shingle numbers of the lower half in ``LEAST_FREQUENT`` documents
    or more.

    Prefixes hold low numbers first, so the lower half is what matters.  Tasks send sorted
    numbers by range, as byte planes of their differences, which compress well.
    """
    parts = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = -(-(1 << 31) // parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                hashes, _, _ = sets(piece.column("text"), rule.words)
                tokens = np.sort((hashes >> np.uint64(32)).astype(np.int64))
                tokens = tokens[: np.searchsorted(tokens, 1 << 31)]
                cuts = np.searchsorted(tokens, np.arange(parts + 1) * width)
                numbers = np.flatnonzero(np.diff(cuts))
                rows = []
                for p in numbers.tolist():
                    own = tokens[cuts[p] : cuts[p + 1]]
                    steps = np.diff(own, prepend=p * width).astype("<u4")
                    rows.append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers.astype(np.int32)), pa.array(rows, pa.binary())],
                    ["part", "planes"],
                )

    def gather(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py() if group.num_rows else 0
        found = [np.zeros(0, np.int64)]
        for planes in group.column("planes"):
            raw = np.frombuffer(planes.as_py(), np.uint8).reshape(4, -1)
            steps = np.ascontiguousarray(raw.T).view("<u4")[:, 0].astype(np.int64)
            found.append(part * width + np.cumsum(steps))
        tokens, counts = np.unique(np.concatenate(found), return_counts=True)
        often = counts >= LEAST_FREQUENT
        return pa.table({"token": tokens[often], "n": counts[often]})

    pieces = documents.select("text").mapInArrow(spread, "part int, planes binary")
    return pieces.groupBy("part").applyInArrow(gather, "token long, n long")


def frequent_tokens(documents: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingle numbers, ascending, and their counts; a bounded number.

    All shingles in at least as many documents as the least power of two that leaves no more
    than ``MOST_FREQUENT`` of them.
    """
    counted = stored(_count(documents, rule))
    level = F.floor(F.log2("n")).alias("level")
    by_level = {r["level"]: r["count"] for r in counted.groupBy(level).count().collect()}
    least, total = 64, 0
    for step in sorted(by_level, reverse=True):
        total += by_level[step]
        if total > MOST_FREQUENT:
            break
        least = step
    rows = counted.where(F.col("n") >= F.lit(2).cast("long") ** least).toArrow()
    tokens, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def features(documents: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, f1, f2, bands, prefix`` of every document, in one map.

    ``f1`` and ``f2`` tell sets apart, ``bands`` are hashes of minimum hashes, ``prefix``
    holds the first shingles in the order of (frequency among the frequent, number).
    """
    context = documents.sparkSession.sparkContext
    frequent = context.broadcast(frequent_tokens(documents, rule))
    seeds = np.random.default_rng(20240501)
    factors = seeds.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = frequent.value
        for batch in batches:
            for piece in tx.slices(batch):
                hashes, owner, n = sets(piece.column("text"), rule.words)
                some = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[some]
                total = np.zeros((2, len(n)), np.uint64)
                bands = np.zeros((len(n), BANDS), np.uint64)
                if len(some):
                    total[0, some] = np.add.reduceat(tx.mix(hashes), begin)
                    total[1, some] = np.add.reduceat(tx.mix(hashes ^ np.uint64(0xA5A5A5A5)), begin)
                    for b in range(BANDS):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(BAND_ROWS):
                            least = np.minimum.reduceat(hashes * factors[b * BAND_ROWS + r], begin)
                            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                        bands[some, b] = key
                rank = np.zeros(len(hashes), np.int64)
                if len(common):
                    token = (hashes >> np.uint64(32)).astype(np.int64)
                    at = np.minimum(np.searchsorted(common, token), len(common) - 1)
                    rank = np.where(common[at] == token, counts[at], 0)
                order = np.lexsort((rank, owner))  # stable: hashes ascend in a document
                length = np.where(n > 0, n - rule.needed(n) + 1, 0)
                nth = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
                first = hashes[order][nth < np.repeat(length, n)].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                across = np.arange(len(n) + 1, dtype=np.int32) * BANDS
                columns = [
                    piece.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array(total[0].view(np.int64)),
                    pa.array(total[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(across), pa.array(bands.ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(first)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "n", "f1", "f2", "bands", "prefix"]
                )

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, bands array<long>, prefix array<long>"
    )


def only(documents: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on ``doc_id``; a counted, bounded list of ids spares the texts a
    shuffle, a longer one is joined by shuffling both."""
    ids = stored(ids.distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return documents.join(ids, "doc_id", how)


def near(pairs: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, linked`` of the pairs whose whole sets are at least half as similar as a link.

    An id with different texts is as near as the nearest of them.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    # dealt by id, texts are told apart and joined to both ends of the pairs by one shuffle
    texts = only(documents.select("doc_id", "text"), ids, "left_semi")
    texts = texts.repartition("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "text_a"):
                left, left_row, n = sets(piece.column("text_a"), rule.words)
                right, right_row, m = sets(piece.column("text_b"), rule.words)
                rows = np.concatenate([left_row, right_row])
                hashes = np.concatenate([left, right])
                order, first = tx.groups(hashes, rows)
                union = np.bincount(rows[order[first]], minlength=len(n))
                common = n + m - union
                close = pa.array((200 * common >= rule.percent * union) & (common > 0))
                good = pa.array(100 * common >= rule.percent * union)
                found = [piece.column("a"), piece.column("b"), good]
                yield pa.RecordBatch.from_arrays(found, ["a", "b", "linked"]).filter(close)

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, linked boolean")


def clusters(grouped: DataFrame, close: DataFrame) -> DataFrame:
    """``class, component, grp, members`` from ``class, component`` and near pairs ``a, b``.

    A component with no larger one near it is a hub (ties: the larger id); any other that is
    near to hubs joins the largest of them, and one that is near to none is a group of its own.
    """
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    edges = (
        close.join(grouped.select(F.col("class").alias("a"), F.col("component").alias("g")), "a")
        .join(grouped.select(F.col("class").alias("b"), F.col("component").alias("h")), "b")
        .where("g <> h")
        .select("g", "h")
    )
    both = (
        edges.unionByName(edges.select(F.col("h").alias("g"), F.col("g").alias("h")))
        .distinct()
        .join(sizes.select(F.col("component").alias("g"), F.col("size").alias("size_g")), "g")
        .join(sizes.select(F.col("component").alias("h"), F.col("size").alias("size_h")), "h")
    )
    both = stored(both)
    hubs = (
        both.groupBy("g")
        .agg(
            F.max(F.struct("size_h", "h")).alias("largest"),
            F.max(F.struct("size_g", "g")).alias("own"),
        )
        .where("own > largest")
        .select(F.col("g").alias("h"))
    )
    homes = both.join(hubs, "h").groupBy("g").agg(F.max(F.struct("size_h", "h"))["h"].alias("hub"))
    placed = grouped.join(homes, grouped["component"] == homes["g"], "left").select(
        "class", "component", F.coalesce("hub", "component").alias("grp")
    )
    members = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    return placed.join(members, "grp").select("class", "component", "grp", "members")


def opened(asks: DataFrame, placed: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """Links ``a, b`` of every class of ``asks(class, grp)`` with the members of the group that
    are of another component: one link for each such component of a block.

    Members and askers are dealt to blocks of about ``BLOCK`` shingles, so that no task holds a
    group; every block of members meets every block of askers.
    """
    asks = stored(asks)
    members = placed.join(asks.select("grp").distinct(), "grp", "left_semi")
    members = stored(members.select("class", "component", "grp"))
    ids = members.select(F.col("class").alias("doc_id")).union(asks.select("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch):
                hashes, _, n = sets(piece.column("text"), rule.words)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                columns = [piece.column("doc_id"), pa.array(n.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", "hashes"])

    texts = only(documents.select("doc_id", "text"), ids, "left_semi")
    hashed = stored(
        texts.mapInArrow(run, "class long, n long, hashes array<long>").where("n > 0").distinct()
    )

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        total = rows.join(hashed.select("class", "n"), "class").groupBy("grp").agg(F.sum("n").alias(name))
        return total.withColumn(name, F.ceil(F.col(name) / BLOCK).cast("int"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return (
            rows.join(deal, "grp")
            .withColumn("own", F.pmod(F.xxhash64("class"), F.col(own)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .withColumnsRenamed({"own": f"{own}_block", "other": f"{other}_block"})
            .drop(own, other)
        )

    deal = stored(blocks(members, "held").join(blocks(asks, "asking"), "grp"))
    askers = asks.join(placed.select("class", "component"), "class")
    columns = ["grp", "held_block", "asking_block", "asks", "class", "component"]
    rows = (
        dealt(members, "held", "asking")
        .withColumn("asks", F.lit(False))
        .select(columns)
        .unionByName(dealt(askers, "asking", "held").withColumn("asks", F.lit(True)).select(columns))
        .join(hashed.select("class", "hashes"), "class")
    )

    def side(table: pa.Table) -> tuple[np.ndarray, ...]:
        lists = table.column("hashes").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.flatten().to_numpy()
        return (
            table.column("class").to_numpy(),
            table.column("component").to_numpy(),
            tokens,
            ends - ends[0],
        )

    def compare(table: pa.Table) -> pa.Table:
        asking = table.column("asks").combine_chunks()
        held, component, tokens, ends = side(table.filter(pa.compute.invert(asking)))
        others, own, asked, stops = side(table.filter(asking))
        found: list[tuple[int, int]] = []
        sizes = np.diff(ends)
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(len(held)), sizes)[order]
        union, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
        least = sizes.min() if len(sizes) else 0
        for i in range(len(others) if len(union) else 0):
            mine = asked[stops[i] : stops[i + 1]]
            n = len(mine)
            at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            at = at[union[at] == mine]
            # the union bounds the overlap with any member
            if (100 + rule.percent) * len(at) < rule.percent * (n + max(least, rule.needed(n))):
                continue
            long = count[at]
            start = np.repeat(first[at] - (np.cumsum(long) - long), long)
            common = np.bincount(owner[start + np.arange(long.sum())], minlength=len(held))
            good = (100 + rule.percent) * common >= rule.percent * (n + sizes)
            good = np.flatnonzero(good & (component != own[i]))
            _, one = np.unique(component[good], return_index=True)
            found += [(others[i], b) for b in held[good[one]].tolist()]
        a, b = (np.array([pair[k] for pair in found], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return rows.groupBy("grp", "held_block", "asking_block").applyInArrow(compare, "a long, b long")


def shared_tokens(entries: DataFrame) -> DataFrame:
    """The rows of ``row, grp, pos, token`` whose token several groups hold.

    Nearly all tokens are held by one group, so the entries are shuffled once, and with no
    more columns than these; what else is known of a row is joined to those that are left.
    """
    of_token = Window.partitionBy("token")
    return (
        entries.withColumn("low", F.min("grp").over(of_token))
        .withColumn("high", F.max("grp").over(of_token))
        .where("low < high")
        .drop("low", "high")
    )


def join(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    The component is the smallest id reachable by links, the row's own included.  Null and
    empty texts have empty sets and no links.  A row without an id links with nothing and
    has a null component.  Rows that repeat an id count as one document, whose texts are
    linked.  Other columns are not read.
    """
    rule = rule or Rule()
    documents = documents.select("doc_id", "text")
    # the number of a row is that of its one written copy
    found = stored(features(documents, rule).withColumn("row", F.monotonically_increasing_id()))
    sized = found.where("doc_id is not null and n > 0")
    narrow = sized.select("doc_id", "f1", "f2")
    classes = narrow.groupBy("f1", "f2").agg(F.min("doc_id").alias("class"))
    of_class = stored(narrow.join(classes, ["f1", "f2"]).select("doc_id", "class"))
    reps = of_class.where("doc_id = class").select("class").distinct()
    # an id with several texts links their classes
    repeated = of_class.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    same_id = of_class.join(repeated.where("low < high"), "doc_id", "left_semi")
    same_id = same_id.select(F.col("doc_id").alias("a"), F.col("class").alias("b"))

    # groups: links with the classes that most others in a bucket of equal hashes are near
    banded = stored(
        sized.select(F.col("doc_id").alias("class"), F.explode("bands").alias("band"))
        .join(reps, "class", "left_semi")
        .distinct()
    )
    crowds = banded.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    crowded = stored(banded.join(crowds, "band"))
    fame = crowded.groupBy("class").agg(F.sum("crowd").alias("fame"))
    first = Window.partitionBy("band").orderBy(F.desc("fame"), "class")
    centres = (
        crowded.join(fame, "class")
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= CENTRES)
        .select("band", F.col("class").alias("b"))
    )
    colliding = (
        crowded.join(centres, "band")
        .where("class <> b")
        .select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b"))
        .distinct()
    )
    close = stored(near(stored(colliding), documents, rule))
    first_links = close.where("linked").select("a", "b").unionByName(same_id)
    found_components = stored(components(first_links))
    grouped = reps.join(found_components, reps["class"] == found_components["node"], "left").select(
        "class", F.coalesce("component", "class").alias("component")
    )
    placed = stored(clusters(stored(grouped), close.where("not linked").select("a", "b")))

    # the matrix: shingles by groups; a shingle of one group only can match nothing
    own = sized.select(F.col("doc_id").alias("class"), "row", "n", "f1", "prefix")
    own = own.join(placed.select("class", "grp", "members"), "class")
    asking = stored(
        shared_tokens(own.select("row", "grp", F.posexplode("prefix").alias("pos", "token")))
        .join(own.select("row", "class", "f1", "n", "members"), "row")
        .select("class", "f1", "n", "grp", "members", "pos", "token")
    )
    matrix = asking.groupBy("token", F.col("grp").alias("other")).agg(
        F.max("members").alias("size"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.min("f1").alias("b_f1"),
        F.max("f1").alias("last_f1"),
        F.min("class").alias("b"),
        F.max("pos").alias("at"),
    )
    # the smaller group asks the larger
    fits = (
        (F.struct("members", "grp") < F.struct("size", "other"))
        & (F.col("high") * 100 >= F.col("n") * rule.percent)
        & (F.col("low") * rule.percent <= F.col("n") * 100)
    )

    def enough(n: str, m: str) -> F.Column:
        """Whether the shingles shared so far and those after the last of them, in the one
        order of all shingles, can make up the overlap that the threshold asks for."""
        most = F.col("shared") + F.least(F.col(n) - F.col("i") - 1, F.col(m) - F.col("j") - 1)
        return most * (100 + rule.percent) >= (F.col(n) + F.col(m)) * rule.percent

    met = (
        asking.join(matrix, "token")
        .where(fits)
        .groupBy("class", "f1", "other")
        .agg(
            F.count(F.lit(1)).alias("shared"),
            F.first("n").alias("n"),
            F.max("size").alias("size"),
            F.min("low").alias("low"),
            F.max("pos").alias("i"),
            F.max("at").alias("j"),
            F.min("b").alias("b"),
            F.min("b_f1").alias("b_f1"),
            F.max("last_f1").alias("last_f1"),
        )
    )
    # a group of one text is bounded like that text; others are bounded by their blocks' unions
    one_text = F.col("b_f1") == F.col("last_f1")
    one = (F.col("size") == 1) & one_text
    qualifying = stored(met.where(~one | enough("n", "low")))
    alone = qualifying.where(one).select(F.col("class").alias("a"), "b").distinct()
    within = placed.where("component <> grp").select("class", "grp")
    across = qualifying.where(~one).select("class", F.col("other").alias("grp"))
    asks = across.unionByName(within).distinct()

    pair_links = near(stored(alone), documents, rule).where("linked").select("a", "b")
    more_links = opened(asks, placed, documents, rule).unionByName(pair_links)

    final = components(first_links.unionByName(more_links))
    class_of = of_class.select(F.col("doc_id").alias("id"), "class")
    home = (
        class_of.join(final, class_of["class"] == final["node"], "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("component", "class")).alias("component"))
    )
    return found.join(home, found["doc_id"] == home["id"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_one(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of ``documents``, one document of each component: that with the least id.

    Rows without an id, and those without words, stay.
    """
    dropped = join(documents, rule).where("doc_id <> component_id").select("doc_id")
    return only(documents, dropped, "left_anti").select(*documents.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by four-word shingles, linked from 85 percent."""
    return join(table(spark, sf_dir, "documents"), Rule(words=4, percent=85))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
commons AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM commons JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id)
GROUP BY d.doc_id, s.n
"""
