"""The idioms that the folds are made of: latest and first row of a key, islands of days, offsets, first-wins dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import running_count, running_last


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first by ``order``. Spark prunes rows before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def latest_values(keys: Sequence[str], order: str, columns: Sequence[str]) -> list[Column]:
    """For each column, its value in the row of greatest ``order`` where it is not null: one aggregate, no join."""
    return [F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in columns]


def islands(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, first_missing, last_missing, n_missing): what lies between successive days of each key."""
    before = F.lag(day).over(W.partitionBy(key).orderBy(day))
    return (
        days.select(key, day).filter(F.col(day).isNotNull()).distinct().withColumn("_before", before).filter(F.datediff(day, "_before") > 1)
        .select(key, F.date_add("_before", 1).alias("first_missing"), F.date_sub(day, 1).alias("last_missing"), (F.datediff(day, "_before") - 1).cast("bigint").alias("n_missing"))
    )


def first_wins(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Keeps the first row of each key; rows with a null in the key are all kept, as they equal none."""
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole = whole & k.isNotNull()
    # rows without a whole key get a key of their own and so spread over all tasks
    own = F.when(~whole, F.monotonically_increasing_id())
    return df.withColumn("_own", own).withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_own").orderBy(*order))).filter("_rank = 1").drop("_rank", "_own")


def assign_offsets(new: DataFrame, heads: DataFrame | None, order: Sequence[str], stream: str = "stream", offset: str = "offset_in_stream") -> DataFrame:
    """Gap-free offsets from 1 in each stream, or from behind the stream's head; hot streams are numbered in blocks."""
    numbered = running_count(new, stream, order, "_n")
    if heads is None:
        return numbered.withColumn(offset, F.col("_n").cast("bigint")).drop("_n")
    return numbered.join(heads.select(stream, F.col(offset).alias("_head")), stream, "left").withColumn(offset, F.col("_n") + F.coalesce("_head", F.lit(0))).drop("_n", "_head")


def as_of(requests: DataFrame, states: DataFrame, key: str, at: str, state_at: str) -> DataFrame:
    """Each request with its key's latest state at or before it, or nulls: a union sorted by time, no pairs.

    ``states`` has key, ``state_at`` and other columns; of states at one time, any may be taken. Hot keys are joined in blocks.
    """
    values = [c for c in states.columns if c != key]
    left = requests.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*requests.columns).alias("_row"), F.lit(None).cast(states.select(F.struct(*values)).schema[0].dataType).alias("_state"))
    right = states.select(key, F.col(state_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_state"))
    seen = running_last(left.unionByName(right), key, ["_at", "_side"], F.col("_state"), "_seen")
    return seen.filter("_side = 1").select("_row.*", *[F.col(f"_seen.{c}").alias(c) for c in values])


