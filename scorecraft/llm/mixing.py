"""Mixing sources to target weights by weighted fair queueing, natively in Spark.

A source's documents are shuffled by a hash of their ids and queue up as often as its target
needs.  An entry's virtual finish time is the source's cumulated size up to and with it,
divided by the source's target.  Entries are taken in the order of finish times over all
sources until the budget is spent, so every source ends near its target.

Prefix sums are taken within buckets of the shuffle hash, on top of the sums of the buckets
before, so a source with a third of all rows is spread over as many tasks as it has buckets;
the global order likewise needs rows of one finish-time bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm.store import stored, table

#: Fixed values of the contract: weights by the source's place in code point order, and the
#: most often that a document may be taken.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task orders at once, about.
BUCKET_ROWS = 20_000
HASH_BITS = 60


def with_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``source, n_source, source_size, target, budget`` from sizes per source.

    Targets share the budget, which is the size of all sources, by weight.  A target stops
    at ``most`` times its source's size; what is over is shared by weight among the others
    until none is above.  With sources in the order of size to weight, those that stop are a
    prefix of them, so running sums find the level at once.  The windows hold one row per
    source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("n_source") % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    ranked = Window.orderBy("full", "n_source").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sources.withColumn("n_source", F.row_number().over(named) - 1)
        .withColumn("weight", cycle.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(ranked), F.lit(0)))
        .withColumn(
            "open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ranked), F.lit(0))
        )
        .withColumn("level", (F.col("budget") - F.col("capped")).cast("double") / F.col("open"))
    )
    # the first source, in this order, that the level does not fill up sets it for the rest
    level = F.min(
        F.when(F.col("level") <= F.col("full"), F.struct("full", "n_source", "level"))
    ).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))
    return placed.withColumn("final", level).select(
        "source",
        "n_source",
        "source_size",
        F.coalesce(target, F.col("cap").cast("double")).alias("target"),
        "budget",
    )


def _bits(rows: int) -> int:
    """Bits of the hash that make buckets of about ``BUCKET_ROWS`` rows."""
    return max(0, (max(rows, 1) // BUCKET_ROWS).bit_length())


def _own() -> tuple[Column, Column]:
    """``size`` and the shuffle hash ``h`` of a document, from its ``doc_id`` and ``text``.

    The text is hashed along, so that rows with one id, or a null one, spread over buckets.
    """
    blank = F.lit("")
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), blank), F.coalesce("text", blank))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return size.alias("size"), F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long").alias("h")


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    ``size`` counts the words of the text (null and empty: 0) and ``taken`` the words that
    the mix takes, repeats included: 0 to ``most`` times the size.  A null source is a source
    of its own.  Rows with one id, or a null one, queue up each by itself; equal rows may
    swap places, which changes no result.  Other columns are not read.  An empty table gives
    an empty result.
    """
    return _taken(documents, weights, most).drop("source", "h")


def _taken(documents: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``mix`` with the ``source`` and the place ``h`` of every row in its queue."""
    sized = stored(documents.select("doc_id", "source", *_own()))
    sources = stored(
        with_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
        )
    )
    totals = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("budget")).first()
    bits = _bits(totals["rows"])
    # without a broadcast hint: Spark decides by the size of the table of sources
    keyed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "doc_id",
        sized["source"],
        "size",
        "h",
        "n_source",
        "source_size",
        "target",
        F.shiftright("h", HASH_BITS - bits).alias("bucket"),
    )
    earlier = Window.partitionBy("n_source").orderBy("bucket")
    offsets = (
        keyed.groupBy("n_source", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .select(
            "n_source",
            "bucket",
            (F.sum("in_bucket").over(earlier) - F.col("in_bucket")).alias("before"),
        )
    )
    queue = Window.partitionBy("n_source", "bucket").orderBy("h", "doc_id", "size")
    running = F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0))
    placed = stored(
        keyed.join(offsets, ["n_source", "bucket"])
        .withColumn("upto", F.col("before") + running)
        .drop("bucket", "before")
    )

    # entries by finish time: whole buckets of it up to the one in which the budget ends
    fine = 1 << (10 + bits // 2)

    def finish(turn: int) -> F.Column:
        reached = (F.lit(turn) * F.col("source_size") + F.col("upto")).cast("double")
        return F.try_divide(reached, F.col("target"))

    def slot(turn: int) -> F.Column:
        return F.least(F.floor(finish(turn) * fine), F.lit(2 * fine)).cast("long")

    def entry(turn: int) -> F.Column:
        return F.struct(
            finish(turn).alias("finish"),
            "n_source",
            F.lit(turn).alias("turn"),
            "h",
            "doc_id",
            "upto",
        )

    turns = range(most)
    entries = placed.where("size > 0").select(
        "size", F.explode(F.array(*[F.struct(slot(t).alias("slot"), F.lit(t).alias("turn")) for t in turns])).alias("e")
    )
    slots = entries.groupBy("e.slot").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.orderBy("slot"))
    edge = (
        slots.select("slot", (upto - F.col("size")).alias("before"), upto.alias("upto"))
        .where(F.col("upto") > F.lit(totals["budget"]))
        .orderBy("slot")
        .first()
    )
    if edge is None:  # no document with words
        last_slot, cut = 0, None
    else:
        last_slot = edge["slot"]
        rows = placed.where("size > 0")
        last = None
        for t in turns:
            part = rows.where(slot(t) == last_slot).select("size", entry(t).alias("entry"))
            last = part if last is None else last.unionByName(part)
        spent = F.lit(edge["before"]) + F.sum("size").over(Window.orderBy("entry"))
        cut = (
            last.select("entry", spent.alias("spent"))
            .where(F.col("spent") <= totals["budget"])
            .agg(F.max("entry").alias("entry"))
        )
        cut = cut.first()["entry"]
    taken = F.lit(0).cast("long")
    for t in turns:
        chosen = slot(t) < last_slot
        if cut is not None:
            literal = F.struct(
                F.lit(cut["finish"]).alias("finish"),
                F.lit(cut["n_source"]).alias("n_source"),
                F.lit(cut["turn"]).alias("turn"),
                F.lit(cut["h"]).alias("h"),
                F.lit(cut["doc_id"]).cast("long").alias("doc_id"),
                F.lit(cut["upto"]).alias("upto"),
            )
            chosen = chosen | ((slot(t) == last_slot) & (entry(t) <= literal))
        taken = taken + F.when(chosen & (F.col("size") > 0), F.col("size")).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "h", "source_size", "target", taken.alias("taken")
    )


def _borders(taken: DataFrame) -> DataFrame:
    """``source, least, last, tied, extra``: how often each source's rows with words are taken.

    A source's taken entries are the first of its queue, turn by turn.  So every row is taken
    ``least`` times, and those up to the place ``last`` once more; a null ``last`` says that
    all are taken equally often.  Of the ``tied`` rows at that very place, which have one id
    and text, ``extra`` are taken once more.  One row a source.
    """
    place = F.struct("h", "doc_id", "size").alias("place")
    rows = taken.where("size > 0").select(
        "source", place, F.expr("cast(taken div size AS int)").alias("copies")
    )
    ends = rows.groupBy("source").agg(
        F.min("copies").alias("least"), F.max(F.struct("copies", "place")).alias("most")
    )
    ends = ends.select(
        F.col("source").alias("of"),
        "least",
        F.when(F.col("most.copies") > F.col("least"), F.col("most.place")).alias("last"),
    )
    tied = rows.join(
        ends, rows["source"].eqNullSafe(ends["of"]) & (rows["place"] == ends["last"])
    ).groupBy("source").agg(
        F.count(F.lit(1)).alias("tied"), F.count_if(F.col("copies") > F.col("least")).alias("extra")
    )
    return ends.join(tied, ends["of"].eqNullSafe(tied["source"]), "left").select(
        F.col("of").alias("source"), "least", "last", "tied", "extra"
    )


def repeat_taken(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it.

    Every row tells its own copies from its place in the queue and its source's border, so
    texts are neither written again nor shuffled.  Where a border parts rows of one id and
    text, one of them stands for those that are taken once more.
    """
    borders = stored(_borders(_taken(documents, WEIGHTS, MOST_REPEATS)))
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(whole, F.col("source").alias("own_source"), *_own(), "doc_id")
    place = F.struct("h", "doc_id", "size")
    # without a broadcast hint: Spark decides by the size of the table of sources
    met = rows.where("size > 0").join(
        borders, rows["own_source"].eqNullSafe(borders["source"])
    ).withColumn("place", place)
    parted = F.col("tied") > F.col("extra")
    once_more = (F.col("place") < F.col("last")) | ((F.col("place") == F.col("last")) & ~parted)
    copies = F.col("least") + F.when(once_more, 1).otherwise(0)
    # rows taken no times repeat an empty list
    result = met.select(F.explode(F.array_repeat("row", copies)).alias("row"))
    if not borders.where(parted).isEmpty():
        more = (
            met.where(parted & (F.col("place") == F.col("last")))
            .groupBy("own_source")
            .agg(
                F.min_by("row", F.to_json("row")).alias("row"),
                F.max("extra").cast("int").alias("extra"),
            )
        )
        result = result.unionByName(more.select(F.explode(F.array_repeat("row", F.col("extra"))).alias("row")))
    return result.select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n_source FROM sources),
full_at AS (
  SELECT *, source_size * 3 AS cap, CASE n_source % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM weighed),
ordered AS (SELECT *, cap::DOUBLE / weight AS full_level FROM full_at),
sums AS (
  SELECT *, sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY full_level, n_source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_level, n_source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM ordered),
levels AS (SELECT *, (budget - capped)::DOUBLE / open_weight AS level FROM sums),
final AS (SELECT level FROM levels WHERE level <= full_level ORDER BY full_level, n_source LIMIT 1),
targets AS (
  SELECT source, n_source, source_size, budget, least(cap::DOUBLE, (SELECT level FROM final) * weight) AS target
  FROM levels),
queued AS (
  SELECT doc_id, size, h, n_source, source_size, target, budget,
         sum(size) OVER (PARTITION BY n_source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT *, (turn * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS t(turn) WHERE size > 0),
spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, n_source, turn, h, doc_id ROWS UNBOUNDED PRECEDING) AS used
  FROM entries),
picked AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM spent WHERE used <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target,
       coalesce(p.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN picked p USING (doc_id)
"""
