"""Operator 1: mixing sources to target weights (Efraimidis-Spirakis sampling).

Every document gets the key -ln(u) / weight, u from a digest of its id. A source with target
t and size s takes floor(t / s) complete epochs; the rest of its budget takes the documents of
the smallest keys until their summed sizes reach it, the last one in part.

No source is ever sorted in one task: the place where a source's prefix sum reaches its budget
is searched by digits of the keys (grouped sums of at most 4,096 cells a source, twice); only
the documents of that one cell, a 16-millionth of the source, are sorted by a window.

The table of sources, one row each, is the only thing that is ordered as a whole.

Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own,
the last; repeated rows are documents of their own with equal keys, ordered by size; a null id draws
its key from the text; very long texts count whole, and one larger than what is left of its source's
budget counts in part (the stage takes it if half of it fits); an empty table gives no rows; other
columns never meet the operator's, which are selected first or begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a key's position, in two digits of 12 bits.
DIGIT = 12
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Sources up to which the source table is broadcast (rows of under 100 bytes).
BROADCAST_SOURCES = 20_000


def sampling_key(size: Column) -> Column:
    """-ln(u) / weight, u from 52 bits of md5 of the id (of the text where the id is null).

    The document's quality weight rises from 0.05 to 1 as its mean word length nears six characters.
    """
    text = common.whole_text()
    per_word = (F.length(text) - size) / F.greatest(size, F.lit(1))
    weight = F.greatest(F.lit(0.05), 1 - F.abs(per_word - 6) / 8)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(text)))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 1) / F.lit(float(2**52 + 1))) / weight


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the sampling key of each document."""
    size = common.word_count(common.whole_text())
    return docs.select("doc_id", "source", "text", size.alias("size")).select("doc_id", "source", "size", sampling_key(F.col("size")).alias("key"))


def source_targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: all words shared by weight, no target above its cap.

    Weights repeat over the sources in code point order, null last. The level at which every
    target is the smaller of cap and level x weight comes from running sums over the sources
    in the order of cap / weight, on the table of sources alone.
    """
    sources = stats.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    by_ratio = Window.orderBy((most_epochs * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    so_far, everyone = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("open_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(so_far), F.lit(0)))
        .withColumn("open_words", F.col("total") - most_epochs * F.coalesce(F.sum("source_size").over(so_far), F.lit(0)))
        .withColumn("level", F.col("open_words") / F.col("open_w"))
        .withColumn("fits", F.col("level") * F.col("w") <= most_epochs * F.col("source_size"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("open_w") * -1, F.col("level")))).over(everyone)["level"]
    target = F.least(F.col("w") * F.coalesce(level, F.lit(0.0)), (most_epochs * F.col("source_size")).cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def digit_columns(key: Column) -> tuple[Column, Column]:
    """The two digits of a key's position between 0 and 1."""
    digits = F.floor(key / (1 + key) * (1 << 2 * DIGIT)).cast("long")
    return F.shiftright(digits, DIGIT), digits.bitwiseAND((1 << DIGIT) - 1)


def cuts(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> tuple[DataFrame, bool]:
    """Per source (s): source_size, target, epochs, budget, and the cell c1, c2 in which the running sum of
    sizes passes the budget, with the sum b2 before it; and whether that table may be broadcast."""
    sources = common.write_shared(source_targets(stats, weights, most_epochs), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = sources.select(F.col("source").alias("s"), "source_size", "target", epochs.alias("epochs"), F.round(F.col("target") - epochs * F.col("source_size")).cast("long").alias("budget"))
    d1, d2 = digit_columns(F.col("key"))
    rows = stats.withColumns({"d1": d1, "d2": d2})

    def cut(cells: DataFrame, digit: str, start: str) -> DataFrame:
        """Per source the cell in which the running sum passes its budget, and the sum before it."""
        order = Window.partitionBy("s").orderBy(digit)
        before = F.col(start) + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run = cells.withColumn("before", before).where("before < budget and before + words >= budget")
        return run.groupBy("s").agg(F.min(F.struct(digit, "before")).alias("c"))

    same = F.col("source").eqNullSafe(F.col("s"))
    one = rows.groupBy("source", "d1").agg(F.sum("size").alias("words")).join(hint(budgets), same).withColumn("zero", F.lit(0))
    first = common.write_shared(cut(one, "d1", "zero").select("s", F.col("c.d1").alias("c1"), F.col("c.before").alias("b1")), "mix-cut")
    held = budgets.join(hint(first.withColumnRenamed("s", "t")), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    two = rows.join(hint(held), same & (F.col("d1") == F.col("c1"))).groupBy("s", "d2", "budget", "b1").agg(F.sum("size").alias("words"))
    second = common.write_shared(cut(two, "d2", "b1").select("s", F.col("c.d2").alias("c2"), F.col("c.before").alias("b2")), "mix-cut")
    return common.write_shared(held.join(hint(second.withColumnRenamed("s", "t")), F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "b1"), "mix-cuts"), few


def taken(docs: DataFrame, size: Column, key: Column, held: DataFrame, few: bool) -> DataFrame:
    """docs with a struct __mix: size, source_size, target, epochs (complete copies), part (words of one more).

    size and key give the size and the sampling key of a row of docs. Every row decides by its own key and its source's cut; only the rows of the cell in which a
    budget ends meet in a window. Whole texts are not shuffled where the sources are few.
    """
    about = F.struct(*(c for c in held.columns if c != "s"))
    own = held.select(F.col("s").alias("__s"), about.alias("__cut"))
    d1, d2 = digit_columns(F.col("__key"))
    c = F.col("__cut")
    rows = docs.withColumn("__size", size).withColumn("__key", key)
    rows = rows.withColumns({"__d1": d1, "__d2": d2}).join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__s")))
    below = (F.col("__d1") < c["c1"]) | ((F.col("__d1") == c["c1"]) & (F.col("__d2") < c["c2"]))
    at_cut = F.coalesce((F.col("__d1") == c["c1"]) & (F.col("__d2") == c["c2"]), F.lit(False))
    clear = rows.where(~at_cut).withColumn("__part", F.when(below, F.col("__size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("__s").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    before = c["b2"] + F.coalesce(F.sum("__size").over(order), F.lit(0))
    edge = rows.where(at_cut).withColumn("__part", F.least(F.col("__size"), F.greatest(c["budget"] - before, F.lit(0))).cast("long"))
    out = F.struct(F.col("__size").alias("size"), c["source_size"].alias("source_size"), c["target"].alias("target"), c["epochs"].alias("epochs"), F.col("__part").alias("part"))
    return clear.unionByName(edge).withColumn("__mix", out).select(*docs.columns, "__mix")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (complete copies) and part (words of one more).

    taken = epochs x size + part; a source's taken words sum to its target, rounded.
    """
    stats = common.write_shared(document_stats(docs), "mix")
    return taken(stats, F.col("size"), F.col("key"), *cuts(stats, weights, most_epochs)).select("doc_id", "source", "__mix.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; taken counts the words of all copies."""
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document as often as its source's mix takes it.

    Documents stay whole: the one that a budget ends in is taken if at least half of it fits.
    """
    stats = common.write_shared(document_stats(docs), "mix")
    m = F.col("__mix")
    copies = (m["epochs"] + (m["part"] * 2 >= F.greatest(m["size"], F.lit(1))).cast("int")).cast("int")
    size = common.word_count(common.whole_text())
    mixed = taken(docs, size, sampling_key(F.col("__size")), *cuts(stats)).withColumn("__copies", copies).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
