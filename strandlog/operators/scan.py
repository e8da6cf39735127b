"""Running values along a key in blocks, so that a key that holds a third of all rows is not one task.

``blocks`` cuts the keys that hold more than their share of the rows into ranges of the order; every other key is one
block. A running value is then made of two parts: one inside a block, by an ordinary window, and one from the summaries
of the key's earlier blocks, at most a few dozen rows for each key that was cut. The summaries are joined by broadcast: their
number is bounded by PARTS squared, whatever the number of rows.

Rows with equal places in the order fall in one block; give an order that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A key is cut if it holds more than one row in PARTS, into PARTS ranges at most; rows looked at for each range.
PARTS, SAMPLED = 64, 32
BLOCK = "_block"


def blocks(df: DataFrame, key: str, order: Sequence[str], parts: int = PARTS) -> tuple[DataFrame, bool]:
    """``df`` with the block of each row, 0 for keys that are not cut, else its range of ``order`` from 0 on; and whether any is cut."""
    total = df.count()
    hot = [(r[key], r["count"]) for r in df.groupBy(key).count().filter(F.col("count") > max(1, total // parts)).collect()]  # fewer than ``parts``
    if not hot:
        return df.withColumn(BLOCK, F.lit(0).cast("long")), False
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    step = spark.createDataFrame([(k, max(1, n // (parts * SAMPLED))) for k, n in hot], f"_hot {kind}, _step long")
    place = F.struct(*order)
    # one row in _step, by a hash of its place, and of those one in SAMPLED is a bound: alike in every run
    some = df.join(F.broadcast(step), df[key].eqNullSafe(step["_hot"])).filter(F.pmod(F.xxhash64(*order), F.col("_step")) == 0)
    some = some.groupBy("_hot").agg(F.sort_array(F.collect_set(place)).alias("_all"))
    bounds = some.select("_hot", F.filter("_all", lambda _, i: i % SAMPLED == SAMPLED - 1).alias("_bounds"))
    cut = df.join(F.broadcast(bounds), df[key].eqNullSafe(bounds["_hot"]), "left")
    behind = F.size(F.filter(F.coalesce("_bounds", F.array().cast(bounds.schema["_bounds"].dataType)), lambda b: b < place))
    return cut.withColumn(BLOCK, behind.cast("long")).drop("_hot", "_bounds"), True


def _carried(cut: DataFrame, any_cut: bool, key: str, summary: Sequence[Column], carry: Column, name: str) -> DataFrame:
    """``cut`` with what each block takes from the key's earlier ones, as ``name``; null in blocks that are a key's first."""
    if not any_cut:
        kind = cut.groupBy(key, BLOCK).agg(*summary).select(carry).schema[0].dataType
        return cut.withColumn(name, F.lit(None).cast(kind))
    per = cut.groupBy(key, BLOCK).agg(*summary)
    several = per.filter(F.col(BLOCK) > 0).select(key).distinct()
    few = per.join(F.broadcast(several.withColumnRenamed(key, "_k")), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    taken = few.select(F.col(key).alias("_k"), F.col(BLOCK).alias("_b"), carry.alias(name)).filter(F.col("_b") > 0)
    return cut.join(F.broadcast(taken), F.col(key).eqNullSafe(F.col("_k")) & (F.col(BLOCK) == F.col("_b")), "left").drop("_k", "_b")


def _before(key: str) -> WindowSpec:
    return W.partitionBy(key).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)


def running_count(df: DataFrame, key: str, order: Sequence[str], name: str, parts: int = PARTS) -> DataFrame:
    """Numbers a key's rows from 1 by ``order``."""
    cut = _carried(*blocks(df, key, order, parts), key, [F.count("*").alias("_carried")], F.sum("_carried").over(_before(key)), "_carried")
    own = F.row_number().over(W.partitionBy(key, BLOCK).orderBy(*order))
    return cut.withColumn(name, own + F.coalesce("_carried", F.lit(0).cast("long"))).drop("_carried", BLOCK)


def running_sum(df: DataFrame, key: str, order: Sequence[str], value: str, name: str, parts: int = PARTS) -> DataFrame:
    """The sum of ``value`` over a key's rows up to and with this one; nulls count nothing."""
    cut = _carried(*blocks(df, key, order, parts), key, [F.coalesce(F.sum(value), F.lit(0)).alias("_carried")], F.sum("_carried").over(_before(key)), "_carried")
    own = F.sum(value).over(W.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn(name, F.coalesce(own, F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_carried", BLOCK)


def running_last(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str, itself: bool = True, parts: int = PARTS) -> DataFrame:
    """The last of ``value`` that is not null among a key's rows before this one, and of this one if ``itself``."""
    cut, any_cut = blocks(df.withColumn("_own", value), key, order, parts)
    last = F.max_by(F.col("_own"), F.when(F.col("_own").isNotNull(), F.struct(*order)))
    cut = _carried(cut, any_cut, key, [last.alias("_carried")], F.last("_carried", ignorenulls=True).over(_before(key)), "_carried")
    own = F.last("_own", ignorenulls=True).over(W.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if itself else -1))
    return cut.withColumn(name, F.coalesce(own, F.col("_carried"))).drop("_own", "_carried", BLOCK)


def row_before(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str, parts: int = PARTS) -> DataFrame:
    """``columns`` of the key's row before this one as a struct, null for the first."""
    return running_last(df, key, order, F.struct(*columns), name, False, parts)
