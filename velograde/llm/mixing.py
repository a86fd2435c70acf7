"""Mixing sources to target weights along a time-varying curriculum.

DataFrame operations only. Each source has a weight schedule over training
time; its integral up to t, scaled to the source's target, is the cumulative
demand for the source's tokens. A document that is taken at cumulative token c
of its source is trained at the time when the demand reaches c, so inverting
the demand gives positions, and sorting by position gives the curriculum.

Totals: targets share all sizes by weight, none above ``cap`` times its source;
the excess is shared again by weight. That is the level L with
sum(min(cap_s, weight_s * L)) = total, found in closed form over the sources
sorted by cap/weight.

Documents: a source whose target is r times its size goes through all its documents
floor(r) times and then through a rest. The rest is laid out in a hash order, each document that fits into what is
left of it, and after these the smallest other one. A pass over a document is taken if the demand reaches the
middle of its place in the source's sequence, that is, if it has a training position. The running sums are in two levels (hash buckets, then inside a
bucket; the number of buckets follows that of the rows), so a source that holds a third of all rows is spread over many tasks.

Defined cases: null texts have size 0 and are taken 0 times; a null source is a
source of its own, last in order; rows without an id, or with an id of others, are told apart by their texts' hashes and decided each;
repeated rows are separate rows, of which equal ones may stand for one another; an empty table yields no rows; a table without
any word has targets 0; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.llm.workdir import rows_below, table, unused

#: Weights of the sources by rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated so many times at most.
CAP = 3
#: Slopes of the weight schedules by rank, repeating: weight(t) = weight * (1 + slope * (2t - 1)), t in 0..1.
SLOPES = (-0.5, 0.0, 0.5)
#: Hash buckets of a source for its running sums: so many at least, and one for so many rows of the table.
BUCKETS, BUCKET_ROWS = 1024, 50_000
#: Targets, one row per source, are broadcast below so many rows; else they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Passes (id and position) are broadcast below so many; else texts are shuffled to them.
BROADCAST_PASSES = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, rank, weight, target) of a table (source, size).

    The windows without a key run over one row per source, not per document.
    """
    by_rank = W.orderBy(F.col("source").isNull(), F.col("source"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(by_rank) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    level = F.col("most") / F.col("weight")
    up_to = W.orderBy(level, "rank").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(level, "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("full", F.coalesce(F.sum("most").over(up_to), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    # With the first k sources full, the rest would share at this level. It rises as long as the
    # next source is above its cap and falls from then on, so the largest is the one that holds.
    fits = (F.col("total") - F.col("full")) / F.col("open")
    filled = filled.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("most"), F.col("weight") * F.col("level"))
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"))


def demand_inverse(share: Column, slope: Column) -> Column:
    """The time t in 0..1 at which a schedule 1 + slope * (2t - 1) has integrated to ``share`` of its whole.

    The integral is slope*t**2 + (1 - slope)*t; of the quadratic's roots the one
    in 0..1, in the form that also holds for slope 0.
    """
    b = 1 - slope
    return F.least(F.lit(1.0), 2 * share / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * slope * share))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document, range-sorted by position: doc_id, source, size, source_size, target, repeats, taken, position.

    ``repeats`` is how often the mix takes the document, ``taken`` its words times
    that, ``position`` the training time of its first pass (null if never taken).
    """
    rows = table(sized(docs, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    placed = table(curriculum(rows, **options), "mix-placed")
    first = F.array_min("positions")
    out = placed.select("doc_id", "source", "size", "source_size", "target", F.size("positions").cast("long").alias("repeats"), (F.col("size") * F.size("positions")).alias("taken"), first.alias("position"))
    return sorted_by(out, F.col("position").asc_nulls_last(), F.col("doc_id"))


def sorted_by(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(doc_id, source, size, hash): the hash tells rows with one id, or without, apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(10)).alias("order"), *more)


def curriculum(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, slopes=SLOPES, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a table (row, doc_id, source, size, order) with source_size, target and ``positions``, the training times of all passes that are taken."""
    targets = source_targets(rows, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = table(targets.withColumn("whole", whole), "mix-targets")
    buckets = max(buckets, rows.count() // BUCKET_ROWS)
    rows = rows.alias("r").join(small(targets).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "rank", "target", "whole")
    rows = rows.withColumn("cell", F.pmod(F.shiftright("order", 32), F.lit(buckets)).cast("int"))
    left = targets.select("rank", F.when(F.col("whole") < cap, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)).alias("left"))
    rest = fitted(rows.select("row", "rank", "cell", "order", "size"), left)
    if rows_below(rest, BROADCAST_PASSES):
        rest = F.broadcast(rest)
    placed = running(rows.join(rest, "row", "left"), {"end": "size"})
    # Where the middle of each pass over the document stands in its source's sequence.
    half = F.col("size") / 2
    laps = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda k: (k - 1) * F.col("source_size") + F.col("end") - half)).otherwise(F.array().cast("array<double>"))
    again = F.when(F.col("rest_end").isNotNull(), F.array(F.col("whole") * F.col("source_size") + F.col("rest_end") - half)).otherwise(F.array().cast("array<double>"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("rank") % len(slopes) + 1).cast("int"))
    reached = F.filter(F.concat(laps, again), lambda m: (m <= F.col("target")) & (F.col("size") > 0))
    positions = F.transform(reached, lambda m: demand_inverse(m / F.col("target"), slope))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", positions.alias("positions"))


def running(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add running sums of columns over the hash order of each source, in two levels: cells, then inside a cell."""
    before = W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("rank", "cell").orderBy("order", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row per source and cell.
    cells = rows.groupBy("rank", "cell").agg(*[F.sum(x).alias(f"_{name}") for name, x in sums.items()])
    cells = cells.select("rank", "cell", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    placed = rows.select("*", *[F.sum(x).over(inside).alias(name) for name, x in sums.items()]).join(cells, ["rank", "cell"])
    return placed.withColumns({name: F.col(f"_{name}") + F.col(name) for name in sums}).drop(*[f"_{name}" for name in sums])


def fitted(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(row, rest_end): in hash order, each document that fits into what is left of its source's rest, then the smallest other one; where each ends.

    Each round places the documents before the first that does not fit; those that are
    larger than what is left then drop out of the running sum of the next round.
    """
    left = left.withColumn("used", F.lit(0).cast("long"))
    open_, taken, shut = rows.where("size > 0"), [], []
    while True:
        # What is too large never fits again.
        fits = open_.join(small(left), "rank")
        shut.append(fits.where("size > left").select("row", "rank", "order", "size"))
        placed = table(running(fits.where("size <= left"), {"end": "size"}), "mix-fit")
        now = placed.where("end <= left")
        if now.isEmpty():
            break
        taken.append(now.select("row", (F.col("used") + F.col("end")).alias("rest_end")))
        more = now.groupBy("rank").agg(F.max("end").alias("more"))
        more = left.join(more, "rank", "left").withColumn("more", F.coalesce("more", F.lit(0)))
        left = table(more.select("rank", (F.col("left") - F.col("more")).alias("left"), (F.col("used") + F.col("more")).alias("used")), "mix-left")
        open_ = placed.where("end > left").drop("end", "left", "used")
    out = shut[0]
    for x in shut[1:]:
        out = out.union(x)
    nearest = out.groupBy("rank").agg(F.min(F.struct("size", "order", "row")).alias("x")).join(small(left), "rank")
    got = nearest.select("x.row", (F.col("used") + F.col("x.size")).alias("rest_end"))
    for x in taken:
        got = got.union(x)
    return table(got, "mix-rest")


def small(rows: DataFrame) -> DataFrame:
    """One row per source: broadcast if there are few."""
    return F.broadcast(rows) if rows_below(rows, BROADCAST_SOURCES) else rows


def passes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, all columns and last ``position`` (``position_``, ... where that is taken), range-sorted by it.

    Each row is decided on its own: rows are numbered in a table, decisions are made on sizes and joined back by number.
    """
    row, position = unused("row", docs.columns), unused("position", docs.columns)
    held = table(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    rows = table(sized(held, id_col, text_col, source_col, F.col(row).alias("row")), "mix-sizes")
    each = table(curriculum(rows, **options).select(F.col("row").alias(row), F.explode("positions").alias(position)), "mix-passes")
    if rows_below(each, BROADCAST_PASSES):
        each = F.broadcast(each)
    joined = held.join(each, row).select(*[held[c] for c in docs.columns], position, row)
    return sorted_by(joined, F.col(position), F.col(row)).drop(row)
