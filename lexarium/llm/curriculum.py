"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a shape, the course of its share over training
time 0..1. The integral of the schedule up to a time is the number of words
the source has to have delivered by then. A source's documents stand in a
keyed random order, as often as their target asks; inverting the integral at a
document's place in the cumulative demand gives its training position, and
the mix is range-sorted by position.

The running sums are taken in two levels, over buckets of the order key and
within them, so no task holds a whole source; the number of buckets follows
from the number of documents. The table of sources, a short row for each, is
the one thing that a single task holds.

The texts move once: to the partition of their position, which the integrated
schedule of all sources gives without sampling, so that partitions hold about
as many words each.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexarium.llm.common import WORD, counted, free_name, met, numbered, spread, written

#: Weights of the sources in code point order, repeating; words mixed over words there are; most passes over a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
#: Slope of a source's share over time, in the same order: its density at time t is 1 + slope * (2t - 1).
SLOPES = (-0.5, 0.5, 0.0)
#: Documents of a bucket, about, where a source had them all; and the least number of buckets.
BUCKET_ROWS, BUCKETS = 8192, 4096
SEED = 17


def sizes(docs: DataFrame) -> DataFrame:
    """docs(row, doc_id, source, text) to (row, doc_id, source, size, order): words of each text and the document's place in the keyed order.

    A document without a doc_id has its place by its text, so many of them don't share one.
    """
    known = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), known)), 1, 12), 16, 10).cast("long")
    return docs.select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("order"))


def _slim(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size, target, slope, tilt), one row for each source. tilt is the slope of all sources together.

    Sharing by weight, stopping a source at its cap and resharing the excess
    ends where every target is min(cap, level * weight); the level follows
    from running sums over the sources in the order in which they reach their
    caps. The table has a row for each source, so its windows are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    cycle = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("rank") % len(xs) + 1)
    per = per.withColumn("rank", rank).withColumns({"weight": cycle(weights), "slope": cycle(slopes), "cap": F.col("source_size") * float(passes)})
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    per = per.withColumn("level", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "slope")
    tilt = F.sum(F.col("target") * F.col("slope")).over(every) / F.greatest(F.sum("target").over(every), F.lit(1e-9))
    return per.withColumn("tilt", tilt)


def position(progress: Column, slope: Column) -> Column:
    """The time at which a source has delivered a share of its words.

    The density 1 + s(2t - 1) integrates to (1 - s)t + st^2; this inverts it.
    """
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * progress)
    return F.when(F.abs(slope) < 1e-9, progress).otherwise((root - (1 - slope)) / (2 * slope))


def _placed(docs: DataFrame, buckets: int | None = None, **how) -> DataFrame:
    """docs(row, doc_id, source, text) to (row, doc_id, source, size, order, source_size, target, tilt, start, positions).

    start: words of the source before the document in its order; positions:
    the training time of each time that the mix takes it, 0 to ``PASSES`` of
    them. Documents without words count as taken while their source's demand
    lasts.
    """
    sized = written(sizes(docs), "sizes")
    per = targets(sized, **how)
    if buckets is None:
        buckets = max(BUCKETS, 1 << ceil(log2(1 + sized.count() / BUCKET_ROWS)))
    step = (1 << 48) // buckets
    keyed = sized.withColumn("bucket", F.floor(F.col("order") / step).cast("int"))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source of its own
    sums = keyed.groupBy(name.alias("name"), "bucket").agg(F.sum("size").alias("sum"))
    offsets = sums.select("name", "bucket", F.coalesce(F.sum("sum").over(W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = W.partitionBy("name", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(W.unboundedPreceding, -1)
    run = keyed.withColumn("name", name).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    per = per.select(name.alias("name"), "source_size", "target", "slope", "tilt")
    # the sources' figures ride on the buckets' rows, so the documents meet one table, by (source, bucket), and no join has a source for its key
    whole = run.join(offsets.join(per, "name"), ["name", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
    times = F.ceil((F.col("target") - F.col("start") - F.col("size") / 2.0) / F.col("source_size"))
    times = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.greatest(times, F.lit(0)), F.lit(how.get("passes", PASSES)))).cast("int")
    whole = whole.withColumn("copies", times)

    def place(copy: Column) -> Column:
        """The cumulative demand at the middle of the document, as a share of the target, inverted."""
        progress = F.least((F.col("start") + copy * F.col("source_size") + F.col("size") / 2.0) / F.greatest("target", F.lit(1e-9)), F.lit(1.0))
        return position(progress, F.col("slope"))

    none = F.array().cast("array<double>")
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1), place)).otherwise(none)
    return whole.select("row", "doc_id", "source", "size", "order", "source_size", "target", "tilt", "start", positions.alias("positions"))


def taken(docs: DataFrame, buckets: int | None = None, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, positions) of every row."""
    placed = _placed(spread(_slim(docs, counted())), buckets, **how)
    return placed.select("doc_id", "source", "size", "order", "source_size", "target", "start", "positions")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Report of the mix: (doc_id, size, source_size, target, taken, positions) of every row of docs(doc_id, source, text, ...).

    positions: the training times, 0 to 1, at which the document is read. Rows
    are range-sorted by the first of them, those not taken last.

    Null texts have size 0; the null source is a source of its own, last in
    order; repeated rows are documents of their own; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    found = taken(docs, **how).withColumn("first", F.get("positions", F.lit(0)))
    report = found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions", "first", "order")
    order = (F.col("first").asc_nulls_last(), "order")
    return report.repartitionByRange(*order).sortWithinPartitions(*order).drop("first", "order")


def schedule(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, copy, position): what training reads, in order of position."""
    placed = taken(docs, **how).select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return placed.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it, in training order.

    Rows are named by their place in the table, so those without a doc_id, and those
    that share one, are each read as often as they are scheduled.
    """
    named, row = numbered(docs, "numbered")
    positions, tilt, place, copy = (free_name(named, n) for n in ("scheduled_positions", "schedule_tilt", "scheduled_position", "scheduled_copy"))
    placed = _placed(_slim(named, F.col(row)), **how).filter(F.size("positions") > 0)
    plan = written(placed.select(F.col("row").alias(row), F.col("positions").alias(positions), F.col("tilt").alias(tilt)), "schedule")
    each = met(named, plan, row, "inner").select("*", F.posexplode(positions).alias(copy, place))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    # the words of all sources before this time, as a share of the mix: partitions of equal words, in order of time
    before = (1 - F.col(tilt)) * F.col(place) + F.col(tilt) * F.col(place) * F.col(place)
    dealt = each.repartitionById(parts, F.least(F.floor(before * parts), F.lit(parts - 1)).cast("int"))
    return dealt.sortWithinPartitions(place, row, copy).select(*docs.columns)
