"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Sources get shares of a budget of words in proportion to their weights; no source is taken more than a number of epochs. The water level that
repeated clamping and resharing leads to is found at once: with sources in order of (epochs x size) / weight, a running sum tells which of them are
at their cap. A document is taken floor(target / size of its source) times; for the fractional epoch, documents are taken in a seeded
order until the rest of the target is met. That order is cut into bins by a hash, so that a source of any size is ordered bin by bin. Copies of one
document (equal identifier and text, which may be a third of all rows) are ordered among themselves by a hash of their row's number, in bins too, so a
source of nothing but copies meets its target as well as any.

Defined results: a null text has size 0, as has an empty one; a null source is a source, the last; a source of size 0 gets target 0 and nothing is taken;
rows without an identifier, or with one that repeats, are documents like others; of equal rows, which ones are taken is open, how many is not; long texts count
whole; ties of the hash fall to the size; extra columns are not read, whatever their names; an empty table gives an empty result. The sources themselves are
put in order in one task: a row of four numbers for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import durable

EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1 << 12
SMALL = 100_000  # sources that may be broadcast; more are joined by a salted shuffle
SALTS = 64


def _bin(h: str) -> Column:
    return F.pmod(F.shiftright(h, 20), F.lit(BINS)).cast("int")


def words(text: Column) -> Column:
    """Number of maximal runs of other bytes than space and 0x09 to 0x0D."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget_share: float = 1.0, epochs: int = EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """src, source_size, target: of rows (src, source_size), one for each source. Weights repeat over sources in code point order, null last."""
    order = Window.orderBy(F.col("src").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("k", F.row_number().over(order) - 1).withColumn("w", F.element_at(wheel, (F.col("k") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_share))).withColumn("all_w", F.sum("w").over(every))
    capped, used = F.coalesce(F.sum("cap").over(level), F.lit(0.0)), F.coalesce(F.sum("w").over(level), F.lit(0.0))
    t = t.withColumn("left", F.col("budget") - capped).withColumn("left_w", F.col("all_w") - used)
    # a source is at its cap if the level that all from it on could reach is not below its ratio
    t = t.withColumn("full", F.col("left") >= F.col("ratio") * F.col("left_w"))
    water = F.min(F.when(~F.col("full"), F.struct("ratio", F.col("k"), (F.col("left") / F.col("left_w")).alias("level")))).over(every)["level"]
    return t.select("src", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * water)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, budget_share: float = 1.0, epochs: int = EPOCHS, weights: tuple[float, ...] = WEIGHTS, carry: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: _id, _source, size, source_size, target, times (whole repetitions taken); with carry also the row, as struct _row.

    row_col names a column that tells rows apart; without one, rows are numbered and kept in a checkpoint.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    text = F.col(f"`{text_col}`").cast("string")
    # a hash of identifier and text orders the documents of a source; copies, whose hashes are equal, are ordered by a hash of the row's number
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("h"), F.xxhash64(F.lit(seed), number).alias("t"), *row)
    d = d.withColumn("bin", _bin("h"))
    if carry and row_col is None:
        d = durable(d)
    slim = durable(d.drop("_row"))  # numbers only: the texts are read once for all that follows, and once more for rows that are carried
    d = d if carry else slim
    bins = slim.groupBy("_source", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = bins.groupBy(F.col("_source").alias("src")).agg(F.sum("bin_size").alias("source_size"))
    targets = source_targets(sizes, budget_share, epochs, weights)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    b = below.join(targets, F.col("_source").eqNullSafe(F.col("src"))).drop("_source")
    # of each source: bins before the edge are in, bins after it out, and within the edge bin documents are ordered
    edge = b.groupBy("src").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.max(F.when(F.col("before") < F.col("rest"), F.struct("bin", "before"))).alias("edge"))
    few = edge.limit(SMALL + 1).count() <= SMALL

    def with_sources(rows: DataFrame, one: DataFrame) -> DataFrame:
        """rows with the columns of a table that has one row for each source, src."""
        if few:
            return rows.join(F.broadcast(one), F.col("_source").eqNullSafe(F.col("src")), "left").drop("src")
        salted = one.withColumn("s2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(salted, F.col("_source").eqNullSafe(F.col("src")) & (F.pmod("t", F.lit(SALTS)).cast("int") == F.col("s2")), "left").drop("src", "s2")

    on_edge = with_sources(slim, edge).where(F.col("bin") == F.col("edge.bin"))
    order = Window.partitionBy("_source").orderBy("h", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = on_edge.groupBy("_source", "h", "size").agg(F.count("*").alias("same"), F.first("edge.before").alias("before"), F.first("rest").alias("rest"))
    cut = cut.withColumn("upto", F.sum(F.col("size") * F.col("same")).over(order) + F.col("before"))
    # the documents that end before the rest are in; of the copies that cross it, so many as come nearest
    cross = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("h", "size", "same", F.round((F.col("rest") - F.col("upto") + F.col("size") * F.col("same")) / F.col("size")).cast("long").alias("k"))))
    cut = durable(cut.groupBy(F.col("_source").alias("src")).agg(cross.alias("cross")).where("cross is not null"))
    copies = with_sources(slim, cut).where((F.col("h") == F.col("cross.h")) & (F.col("size") == F.col("cross.size"))).withColumn("tbin", _bin("t"))
    parts = copies.groupBy("_source", "tbin").agg(F.count("*").alias("n"), F.first("cross.k").alias("k"))
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("tbin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = parts.where("start < k").groupBy(F.col("_source").alias("src")).agg(F.max(F.struct("tbin", "start", "k")).alias("part"))
    inner = with_sources(copies, part).where(F.col("tbin") == F.col("part.tbin"))
    inner = inner.withColumn("r", F.row_number().over(Window.partitionBy("_source").orderBy("t"))).where(F.col("r") <= F.col("part.k") - F.col("part.start"))
    last = inner.groupBy(F.col("_source").alias("ls")).agg(F.max("tbin").alias("tbin"), F.max("t").alias("t_last"))
    one = edge.join(cut.withColumnRenamed("src", "cs"), F.col("src").eqNullSafe(F.col("cs")), "left").drop("cs")
    one = one.join(last, F.col("src").eqNullSafe(F.col("ls")), "left").drop("ls")
    d = with_sources(d, one)
    here, at = F.struct("h", "size"), F.struct("cross.h", "cross.size")
    copy = (_bin("t") < F.col("tbin")) | ((_bin("t") == F.col("tbin")) & (F.col("t") <= F.col("t_last")))
    inside = F.when(F.col("cross").isNull() | (here < at), 1).when((here == at) & F.coalesce(copy, F.lit(False)), 1).otherwise(0)
    extra = F.when(F.col("rest") <= 0, 0).when(F.col("bin") < F.col("edge.bin"), 1).when(F.col("bin") == F.col("edge.bin"), inside).otherwise(0)
    return d.select("_id", "_source", "size", "source_size", "target", (F.col("whole") + F.coalesce(extra, F.lit(0))).cast("long").alias("times"), *(["_row"] if carry else []))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken over all documents."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
