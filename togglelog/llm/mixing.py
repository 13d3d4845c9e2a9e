"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u from a digest of its doc_id and a seed and
the weight from its quality. A source's documents in key order are a weighted random order; a source
takes whole epochs while its target allows, and then documents in that order until the rest of its
token budget is used up.

Prefix sums over a source are taken in two steps, so that no task holds a whole source: the key axis is
cut into cells, the same for every source; sums of cells are accumulated per source (at most CELLS
rows each), and only documents of the cells around the cut are put in order one by one.

Documents are whole: when the next one would exceed what is left, the prefix sum starts again over
the later documents that still fit, until none does. So a source misses less than the smallest document that
comes after its last. Each start sums the cells of these documents, which are written out and so get fewer,
and puts one cell in order. Once no source has more than FOLD_ROWS of them, one task a source takes the rest of its
way in order, one by one, which is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from togglelog.llm.storage import as_row, from_row, written
from togglelog.llm.words import WORD

CELLS = 65_536
# Broadcast the per-source table up to so many sources; join it with a shuffle beyond.
BROADCAST_SOURCES = 10_000
SOURCE_WEIGHTS = (5, 2, 1)
# Documents of a source behind its cut that one task goes through.
FOLD_ROWS = 200_000
# Characters of junk, by which quality falls.
JUNK = "#*$%&|<>{}[]=_~^@\\0123456789"


def text_quality(text: Column) -> Column:
    """A weight from 0.01 to 1: the share of characters that are not digits or symbols, squared."""
    clean = F.length(F.translate(text, JUNK, "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.coalesce(clean * clean, F.lit(0.0)), F.lit(0.01))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u from the first 52 bits of an md5 digest of the seed and doc_id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights=SOURCE_WEIGHTS) -> DataFrame:
    """(source, source_size, target): sizes (source, source_size) shared out by weight under a cap.

    Sources in code point order, null last, have the weights in turn. Together they get `share` of
    all words; none gets more than `most` times its size, and what it can't use goes to the others by
    weight. The windows run over one row for each source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weighed = sizes.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn - 1, F.lit(len(weights))).cast("int") + 1)
    ).withColumn("cap", most * F.col("source_size"))
    # Sources reach their cap in the order of cap / weight. The level (words for a unit of weight) is
    # what is left by those before, over the weight of the rest, at the first that stays under its cap.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    at = F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    is_open = F.col("level") <= F.col("cap") / F.col("w")
    first_open = F.min_by(F.when(is_open, F.col("level")), F.when(is_open, at)).over(all_rows)
    leveled = weighed.withColumn("level", level).withColumn("cut", first_open)
    capped = F.col("cut").isNull() | (F.col("cap") / F.col("w") < F.col("cut"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("w") * F.col("cut"))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    share: float = 1.5,
    most: int = 2,
    weights: tuple = SOURCE_WEIGHTS,
    seed: str = "mix",
    cells: int = CELLS,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """docs with size, source_size, target, copies (times a document is taken) and taken (words).

    Sizes are words; a null text has none. `quality` is a positive weight per document (default:
    `text_quality`). A null source is a source. Documents without words are taken with every epoch, the
    last one that is cut too, and cost nothing. Rows equal in doc_id, source, size and weight are one
    unit, taken or left together. Reruns agree, whatever the partitions. Other columns are passed on, those named like a
    new column are replaced; an empty table stays empty.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    rest = [c for c in docs.columns if c not in made]
    weight = text_quality(F.col("text")) if quality is None else quality
    sized = docs.select(
        as_row(rest), "doc_id", "source", word_count(F.col("text")).alias("size"), exponential_key(weight, seed).alias("_key")
    )
    # a key's cell: the distribution function of the key under weight 1, in equal steps
    cell = F.least(F.floor((1 - F.exp(-F.col("_key"))) * cells), F.lit(cells - 1))
    sized = sized.withColumn("_cell", cell.cast("int"))
    keys = ["doc_id", "source", "size", "_key"]
    units = sized.groupBy(*keys, "_cell").agg((F.count(F.lit(1)) * F.col("size")).alias("unit"))
    light = written(units, "mix")
    sums = written(light.groupBy("source", "_cell").agg(F.sum("unit").alias("words")), "mix-cells")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = written(targets, "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES

    def with_sources(df: DataFrame, side: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
        side = side.select(F.col("source").alias("_source"), *columns)
        return df.join(F.broadcast(side) if small else side, df["source"].eqNullSafe(F.col("_source")), how).drop("_source")

    running = Window.partitionBy("source").orderBy("_cell")
    sums = with_sources(sums.withColumn("upto", F.sum("words").over(running)), targets, "budget")
    cuts = written(_cuts(sums.withColumnRenamed("budget", "gap")), "mix-cuts")
    chosen = _after_the_cut(light, cuts.where("gap > 0"), with_sources, fold_rows)
    taken = with_sources(with_sources(sized, targets, "source_size", "target", "epochs", how="left"), cuts, "full", how="left")
    on = [taken[k].eqNullSafe(chosen[k]) for k in keys]
    at_cut = (F.col("_cell") <= F.col("full")) | F.col("chosen") | (taken["size"] == 0)
    extra = F.when(F.col("budget_left") & at_cut, 1).otherwise(0)
    copies = (F.col("epochs") + extra).cast("long")
    return (
        taken.withColumn("budget_left", F.col("target") > F.col("epochs") * F.col("source_size"))
        .join(chosen, on, "left")
        .select(
            *from_row(rest),
            taken["size"],
            "source_size",
            "target",
            copies.alias("copies"),
            (copies * taken["size"]).alias("taken"),
        )
    )


def _cuts(sums: DataFrame) -> DataFrame:
    """(source, gap, full, words, cell): the last cell that ends within the gap, the words up to there, the next cell."""
    within = F.col("upto") <= F.col("gap")
    return sums.groupBy("source", "gap").agg(
        F.coalesce(F.max(F.when(within, F.col("_cell"))), F.lit(-1)).alias("full"),
        F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0)).alias("words"),
        F.min(F.when(~within, F.col("_cell"))).alias("cell"),
    )


def _after_the_cut(light: DataFrame, cuts: DataFrame, with_sources: Callable, fold_rows: int) -> DataFrame:
    """(doc_id, source, size, _key, chosen = true): units after the first full cells that are taken."""
    keys = ["doc_id", "source", "size", "_key"]
    place = F.struct("_key", "doc_id", "size")
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size")
    by_cell = Window.partitionBy("source").orderBy("_cell")
    known = ["gap", "full", "words", "cell"]
    later, chosen = light, light.where("false").select(*keys)
    rest = with_sources(light, cuts, *known)
    while True:
        at_cut = rest.where("_cell = cell").withColumn("upto", F.col("words") + F.sum("unit").over(order))
        at_cut = written(at_cut.select(*keys, "gap", "words", "upto"), "mix-near")
        chosen = chosen.union(at_cut.where("upto <= gap").select(*keys))
        # the first that doesn't fit, and what is left for those after it
        used = F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.col("words"))
        at = F.min(F.when(F.col("upto") > F.col("gap"), place)).alias("at")
        state = at_cut.groupBy("source", "gap", "words").agg(used.alias("used"), at)
        state = state.select("source", (F.col("gap") - F.col("used")).alias("gap"), "at")
        state = written(state.where("gap > 0"), "mix-left")
        if state.isEmpty():
            return chosen.withColumn("chosen", F.lit(True))
        fitting = (F.col("unit") > 0) & (F.col("unit") <= F.col("gap")) & (place > F.col("at"))
        later = written(with_sources(later, state, "gap", "at").where(fitting).drop("at", "gap"), "mix-later")
        most = later.groupBy("source").count().agg(F.max("count")).first()[0]
        if (most or 0) <= fold_rows:
            numbered = with_sources(later, state, "gap").select(*keys, "unit", "gap", F.row_number().over(order).alias("n"))
            kinds = ", ".join(f"{c} {later.schema[c].dataType.simpleString()}" for c in keys)
            fitted = numbered.groupBy("source").applyInArrow(_one_by_one, kinds)
            return chosen.union(written(fitted, "mix-last")).withColumn("chosen", F.lit(True))
        sums = with_sources(later, state, "gap").groupBy("source", "gap", "_cell").agg(F.sum("unit").alias("upto"))
        cuts = written(_cuts(sums.withColumn("upto", F.sum("upto").over(by_cell))), "mix-cuts")
        rest = with_sources(later, cuts, *known)
        chosen = chosen.union(written(rest.where("_cell <= full").select(*keys), "mix-whole"))


def _one_by_one(units: pa.Table) -> pa.Table:
    """The units of a source that are taken when each, in the order of `n`, is taken if it still fits."""
    units = units.sort_by("n")
    left, taken = units.column("gap")[0].as_py(), []
    for i, unit in enumerate(units.column("unit").to_pylist()):
        if unit <= left:
            taken.append(i)
            left -= unit
    return units.take(pa.array(taken, pa.int64())).select(["doc_id", "source", "size", "_key"])
