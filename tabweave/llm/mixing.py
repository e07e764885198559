"""Operator 6: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source has a weight and gets its share of `share` times all words. A target
stops at `cap` times its source's words; what is over goes to the others by weight
until none is above (the level that fills this is found in closed form from the
sources sorted by cap over weight). A source's target is full epochs of all its
documents, then a fractional epoch: documents get exponential keys -ln(u) / quality,
u drawn from the MD5 of the key column and the text, are sorted within the source and taken while the
prefix sum of their words stays nearest to what is left.

The prefix sum has two levels: words are summed in about sqrt(n) key ranges of a
source, and only the range where the budget ends is sorted. So a source with a third
of all rows costs each task some sqrt(n) rows. Its result is one cut-off key for each
source, which every document is compared with.

Defined results: null text has 0 words; null source is a source of its own, the last;
rows with equal key and text share a draw, and where the budget ends among them as many
are taken as come nearest to it (which ones is all the same); documents without words are
taken 0 words; texts of any length are counted whole; an empty table gives an empty result; other columns pass through, and
those named as outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, blank_null, keep

#: Fixed value: characters that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"
#: Sources up to which the table of cut-offs (some 60 bytes a source) is broadcast.
BROADCAST_SOURCES = 100_000
ADDED = ["size", "mix_key", "source_size", "target", "taken", "copies"]


def quality(text: str = "text") -> Column:
    """1 for text without symbols, falling to 0.1 as their share rises to 18 %."""
    t = blank_null(text)
    share = 1 - F.length(F.translate(t, SYMBOLS, "")) / F.greatest(F.length(t), F.lit(1))
    return F.when(F.length(t) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - 5 * share))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """Adds `size` in words and the exponential key `mix_key`."""
    docs = docs.drop(*ADDED)
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(blank_null(text)))), 1, 13), 16, 10)
    u = (digits.cast("double") + 1) / float(1 << 52)
    return docs.withColumns({"size": F.regexp_count(blank_null(text), F.lit(WORD)).cast("long"), "mix_key": -F.log(u) / (quality(text) if weight is None else weight)})


def targets(measured: DataFrame, weights: tuple[float, ...], share: float, cap: float, source: str) -> DataFrame:
    """source, n, source_size, target: a row for each source."""
    s = measured.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", cap * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    return s.select("source", "n", "source_size", F.least("cap", F.max("level").over(everything) * F.col("w")).alias("target"))


def cutoffs(measured: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, source: str = "source") -> DataFrame:
    """source, source_size, target, epochs, cutoff, ties: documents with mix_key <= cutoff are taken once more, of those at the cutoff `ties` (null: all)."""
    rows = measured.select(F.col(source).alias("source"), "size", "mix_key")
    plan = targets(measured, weights, share, cap, source)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.sqrt("n")).cast("long"))
    plan = keep(plan.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", "ranges"))
    # 1 - exp(-key) rises with the key, so the ranges are in the order of the keys
    ranged = beside(rows, plan, "source").withColumn("range", F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * F.col("ranges")), F.col("ranges") - 1))
    sums = ranged.groupBy("of", "range").agg(F.sum("size").alias("words"), F.max("mix_key").alias("last"), F.first("rest").alias("rest"))
    so_far = F.sum("words").over(Window.partitionBy("of").orderBy("range"))
    sums = keep(sums.withColumn("start", so_far - F.col("words")).withColumn("end", so_far))
    whole = sums.where("end <= rest").groupBy("of").agg(F.max("last").alias("whole"))
    edge = sums.where("start < rest and end > rest").select(F.col("of").alias("edge_of"), F.col("range").alias("edge_range"), "start")
    edge = F.broadcast(edge) if plan.count() <= BROADCAST_SOURCES else edge
    inside = ranged.join(edge, ranged["of"].eqNullSafe(F.col("edge_of")) & (F.col("range") == F.col("edge_range")))
    inside = inside.groupBy("of", "mix_key").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("each"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    so_far = F.col("start") + F.sum("words").over(Window.partitionBy("of").orderBy("mix_key")) - F.col("words")
    fit = F.when(F.col("words") == 0, F.col("n")).otherwise(F.least("n", F.floor((F.col("rest") - so_far) / F.col("each") + 0.5)))
    inside = inside.withColumn("fit", fit).where("fit > 0")
    part = inside.groupBy("of").agg(F.max("mix_key").alias("part"), F.max_by(F.when(F.col("fit") < F.col("n"), F.col("fit")), "mix_key").alias("ties"))
    out = plan
    for t in (whole.withColumnRenamed("of", "a"), part.withColumnRenamed("of", "a")):
        out = out.join(t, out["of"].eqNullSafe(t["a"]), "left").drop("a")
    return keep(out.select("of", "source_size", "target", "epochs", F.greatest("whole", "part").alias("cutoff"), F.when(F.col("part") >= F.coalesce("whole", "part"), F.col("ties")).alias("ties")))


def beside(rows: DataFrame, plan: DataFrame, source: str, of: str = "of") -> DataFrame:
    small = plan.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, rows[source].eqNullSafe(plan[of]))


def apply(measured: DataFrame, cuts: DataFrame, source: str = "source") -> DataFrame:
    """Adds source_size, target, copies (times that the mix holds the document) and taken (its words times copies)."""
    plan = cuts.select(F.col("of").alias("_mix_of"), "source_size", "target", F.col("epochs").alias("_mix_epochs"), F.col("cutoff").alias("_mix_cutoff"), F.col("ties").alias("_mix_ties"))
    out = beside(measured, plan, source, "_mix_of")
    out = out.withColumn("_mix_again", F.when(F.col("mix_key") <= F.col("_mix_cutoff"), 1).otherwise(0))
    tied = F.coalesce((F.col("mix_key") == F.col("_mix_cutoff")) & F.col("_mix_ties").isNotNull(), F.lit(False))
    if not cuts.where("ties is not null").isEmpty():
        out = out.where(~tied).unionAll(_first_of_ties(out.where(tied)))
    out = out.withColumn("copies", F.col("_mix_epochs") + F.col("_mix_again"))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop(*[c for c in out.columns if c.startswith("_mix_") and c != "_mix_row"])


def _first_of_ties(rows: DataFrame) -> DataFrame:
    """Rows with one draw: `_mix_ties` of each source are taken, numbered partition by partition so that no task has them all."""
    rows = keep(rows).withColumn("_mix_part", F.spark_partition_id())
    in_part = Window.partitionBy("_mix_of", "_mix_part").orderBy("mix_key")
    each = rows.groupBy(F.col("_mix_of").alias("_mix_a"), F.col("_mix_part").alias("_mix_b")).agg(F.count("*").alias("_mix_n"))
    each = each.withColumn("_mix_before", F.sum("_mix_n").over(Window.partitionBy("_mix_a").orderBy("_mix_b")) - F.col("_mix_n"))
    rows = rows.withColumn("_mix_number", F.row_number().over(in_part))
    both = rows.join(each, rows["_mix_of"].eqNullSafe(each["_mix_a"]) & (F.col("_mix_part") == F.col("_mix_b")))
    both = both.withColumn("_mix_again", F.when(F.col("_mix_before") + F.col("_mix_number") <= F.col("_mix_ties"), 1).otherwise(0))
    return both.drop("_mix_part", "_mix_a", "_mix_b", "_mix_n", "_mix_before", "_mix_number")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix holds them: each row, all its own columns, as many times as `copies` says."""
    measured = measure(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), "doc_id", "source", "text"))
    cuts = cutoffs(measured.select("source", "size", "mix_key"), **options)
    out = apply(measured, cuts).where("copies > 0")
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_mix_row.*")
