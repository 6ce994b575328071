"""The difference-cover suffix sort of one text over all tasks, in DataFrame operations.

`suffixes` sorts within blocks instead: this form shuffles a text many times over (figures in the README). It stands beside it
for texts that no block holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize
from .suffixes import suffix_array

#: Symbols that one task sorts by itself.
SMALL = 1 << 16
_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in this order: ranges of it are dealt out and sorted, rows counted within a range, and a row a range summed up."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__id", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.select(*df.columns, (F.col("__start") + F.col("__id").bitwiseAND(_ROW)).alias(name))


def _ahead(rows: DataFrame, value: str, names: list[str]) -> DataFrame:
    """(pos, names...): the value at pos, pos + 1, ..., 0 where there is none. One shuffle."""
    moved = rows.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.struct((F.col("pos") - k).alias("pos"), F.col(value).alias("v")))).alias("k", "m"))
    pick = lambda i: F.coalesce(F.max(F.when(F.col("k") == i, F.col("m.v"))), F.lit(0))
    return moved.where("m.pos >= 0").groupBy(F.col("m.pos").alias("pos")).agg(*(pick(i).alias(n) for i, n in enumerate(names)))


def _alone(symbols: DataFrame) -> DataFrame:
    def run(pdf):
        pdf = pdf.sort_values("pos")
        order = suffix_array(pdf["s"].to_numpy(np.int64))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        return pdf.assign(rank=rank)[["pos", "rank"]]

    return symbols.groupBy((F.col("pos") * 0).alias("one")).applyInPandas(run, "pos long, rank long")


def suffix_ranks(symbols: DataFrame, small: int = SMALL) -> DataFrame:
    """(pos, rank) of every suffix, ranks from 1, of the text (pos 0 to n - 1, s above 0).

    Suffixes at places 1 and 2 modulo 3 are named by their triples, sorted by ranges; while names repeat, the names are a shorter text that is sorted in the same
    way. The others follow from their first symbol and the next rank. To merge, each of them is counted into the sampled suffixes of either kind.
    """
    symbols = materialize(symbols.select("pos", F.col("s").cast("long").alias("s")), "symbols")
    n = symbols.count()
    if n <= small:
        return _alone(symbols)
    mod: Column = F.col("pos") % 3
    # Where n is 1 modulo 3, an empty suffix is sampled too, so that the last place has a next rank.
    text = symbols.unionByName(symbols.sparkSession.createDataFrame([(n, 0)], "pos long, s long")) if n % 3 == 1 else symbols
    wide = materialize(_ahead(text, "s", ["s0", "s1", "s2"]), "triples")
    triple = ["s0", "s1", "s2"]
    sample = wide.where(mod != 0)
    named = materialize(sample.join(numbered(sample.select(*triple).distinct(), triple, "name"), triple).select("pos", (F.col("name") + 1).alias("name")), "names")
    names, places = named.agg(F.max("name"), F.count("*")).first()
    ones = (n + 1) // 3 + (n % 3 == 1)
    if names == places:
        rank = named.select("pos", F.col("name").alias("r"))
    else:
        at = F.floor(F.col("pos") / 3) + F.when(mod == 2, ones).otherwise(0)
        deeper = suffix_ranks(named.select(at.alias("pos"), F.col("name").alias("s")), small)
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        rank = deeper.select(back.alias("pos"), F.col("rank").alias("r"))
    full = materialize(wide.join(_ahead(rank, "r", ["r0", "r1", "r2"]), "pos", "left").fillna(0), "ranks")
    zero = materialize(numbered(full.where(mod == 0), ["s0", "r1"], "z"), "zeros")

    def before(kind: int, key: list[str]) -> DataFrame:
        """(z, how many sampled suffixes of this kind come before it)."""
        both = zero.select(*key, "z").unionByName(full.where(mod == kind).select(*key, F.lit(None).cast("long").alias("z")))
        return numbered(both, key, "i").where("z is not null").select("z", (F.col("i") - F.col("z")).alias(f"b{kind}"))

    counted = zero.select("pos", "z").join(before(1, ["s0", "r1"]), "z").join(before(2, ["s0", "s1", "r2"]), "z")
    placed = counted.select("pos", (F.col("b1") + F.col("b2")).alias("key"), F.lit(0).alias("kind"), "z")
    placed = placed.unionByName(full.where(mod != 0).select("pos", (F.col("r0") - 1).alias("key"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("z")))
    out = materialize(numbered(placed, ["key", "kind", "z"], "i").where(F.col("pos") < n).select("pos", (F.col("i") + (0 if n % 3 == 1 else 1)).alias("rank")), "sorted")
    discard(symbols, wide, named, full, zero)
    return out
