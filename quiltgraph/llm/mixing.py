"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose documents come in a shuffled order, pass after
pass.  A copy's virtual finish time is the source's cumulative tokens over its
target, where the copy itself counts by half, so that a source ends at the copy
that lies nearest to its target.  Copies are served in the order of finish
times until the total budget is used, again by the nearest copy.

Running sums never need one task: rows fall into buckets of the shuffled
order (or of finish time), bucket totals are summed first, and a window runs
only inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Times that a document may be taken, and so the most a target is of its source's size.
PASSES = 3
#: Rows that a bucket holds on average, and the buckets of all finish times.
BUCKET_ROWS = 500
TICKS = 16384
SEED = 20240229


WHITE = " \t\n\x0b\x0c\r"


def words(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 of null."""
    bare = F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def flow(source: str) -> Column:
    """A source as a key without nulls, in code point order with null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """flow, source_size and target of a table with flow and source_size, one row a source.

    Sources weigh 1, 2, 3, 1, ... in their order.  With p = PASSES * size and w
    a source's weight, repeated resharing of the excess by weight ends at the
    targets min(p, level * w) whose sum is the total.  Sources reach their stop
    in the order of p / w, so running sums in that order give the level.  The
    windows are as long as there are sources.
    """
    ranked = sizes.withColumn("w", ((F.row_number().over(Window.orderBy("flow")) - 1) % 3 + 1).cast("double"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "flow").rowsBetween(Window.unboundedPreceding, -1)
    stop = ranked.withColumn("stop", (F.col("source_size") * PASSES).cast("double")).withColumn("ratio", F.col("stop") / F.col("w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # level: if all sources before this one have stopped and no other has; the first ratio above its level is right
    found = stop.withColumn("level", left / weight)
    found = found.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    return found.select("flow", "source_size", F.least("stop", F.coalesce(F.col("final") * F.col("w"), F.col("stop"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, rid, size, source_size, target, copies, taken.

    copies is how often the mix takes the document, taken = copies * size.  A
    document without words costs nothing and is taken once.  Null sources form
    a source of their own; null ids and repeated rows take part like any other
    row.  The order within a source is by a seeded hash of id and text, so
    reruns agree.  A source takes its target but for about half a document; the
    total may pass the budget by half of the last one.  Very long texts are
    counted whole.  rid is xxhash64 of the text;
    other columns are ignored.
    """
    rid = F.xxhash64(F.col(text))
    sized = stored(docs.select(F.col(id).alias("doc_id"), rid.alias("rid"), flow(source).alias("flow"), words(text).alias("size"), F.xxhash64(F.lit(SEED), F.col(id), F.col(text)).alias("place")))
    count, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = 1 << max(0, (count // BUCKET_ROWS).bit_length())
    sources = targets(sized.groupBy("flow").agg(F.sum("size").alias("source_size")))

    # cumulative tokens in the shuffled order of each source: bucket totals first
    placed = sized.withColumn("bucket", ((F.shiftright("place", 40) + (1 << 23)) * buckets / (1 << 24)).cast("int"))
    sums = placed.groupBy("flow", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("flow").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("flow", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset")).join(sources, "flow")
    inside = Window.partitionBy("flow", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("within", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside)).join(offsets, ["flow", "bucket"])

    # a copy of each pass has its virtual finish time; at 1 every source has its target
    upto = F.col("within") + F.col("offset") - F.col("size") / 2
    finish = F.array(*[F.when(F.col("target") > 0, (upto + F.col("source_size") * k) / F.col("target")).otherwise(F.lit(0.0)) for k in range(PASSES)])
    queued = stored(run.withColumn("finish", finish).drop("within", "offset"))
    copies = queued.where("size > 0").select("flow", "place", "nth", "size", F.explode("finish").alias("time"))

    # the tick in which the budget runs out, and what the ticks before it take; the pace of a time, from 0 to 1, keeps their number bounded
    pace = lambda t: t / (t + 1) * TICKS
    tick = lambda t: F.floor(pace(t))
    sums = copies.groupBy(tick(F.col("time")).alias("tick")).agg(F.sum("size").alias("tick_size"))
    running = F.sum("tick_size").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = sums.withColumn("upto", running).where(F.col("upto") > total).orderBy("tick").limit(1).collect()
    last, before = (edge[0]["tick"], edge[0]["upto"] - edge[0]["tick_size"]) if edge else (TICKS, total)
    sure = queued.withColumn("sure", F.size(F.filter("finish", lambda t: tick(t) < last)))

    # that one tick is served in its exact order, in ranges of time
    served = copies.where(tick(F.col("time")) == last)
    ranges = max(1, served.count() // BUCKET_ROWS)
    served = served.withColumn("range", F.floor((pace(F.col("time")) - last) * ranges))
    sums = served.groupBy("range").agg(F.sum("size").alias("range_size"))
    earlier = F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("range", F.coalesce(earlier, F.lit(0)).alias("offset"))
    order = Window.partitionBy("range").orderBy("time", "flow", "place", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # in this order the middles of copies never fall back, so at most one copy reaches beyond the budget
    middle = F.col("within") + F.col("offset") + before - F.col("size") / 2
    served = served.withColumn("within", F.sum("size").over(order)).join(offsets, "range").where(middle <= total)
    extra = served.groupBy("flow", "place", "nth").agg(F.count("*").alias("extra"))
    out = sure.join(extra, ["flow", "place", "nth"], "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("sure") + F.coalesce("extra", F.lit(0))).otherwise(1).cast("int"))
    return out.select("doc_id", "rid", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows with the same id and text are taken as often as the mix takes them in
    all; which of them is repeated is not told apart.  Only such rows are numbered.
    """
    taken = mix(docs, text, source, id).groupBy(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    taken = stored(taken)
    rows = docs.withColumn("_own", F.xxhash64(F.col(text)))
    own = lambda some: rows.join(some, F.col(id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_rid")))
    single = own(taken.where("_rows = 1")).withColumn("_times", F.col("_copies").cast("int"))
    # of several equal rows, the first ones take what doesn't divide evenly
    nth = F.row_number().over(Window.partitionBy("_id", "_rid").orderBy("_rid"))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("int")
    out = single.union(own(taken.where("_rows > 1")).withColumn("_times", share.cast("int")))
    out = out.where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.drop("_own", "_id", "_rid", "_copies", "_rows", "_times", "_time")
