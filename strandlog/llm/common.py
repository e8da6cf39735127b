"""Helpers that the operators share: reading, row keys, bindings inside expressions, durable tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: White space that separates words in the word rules: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of just this name, whatever is in it."""
    return F.col(f"`{column.replace('`', '``')}`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, space: str = SPACE) -> Column:
    """The words of a text between runs of ``space``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), space), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def span(first: Column, last: Column) -> Column:
    """The longs from first to last, or no longs if last is smaller."""
    return F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """``[0, v0, v0+v1, ...]`` of an array of longs.

    Blocks keep the work proportional to the array's length times ``block``, also for very long texts.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def plain(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
        return let(plain(sums), lambda offs: F.concat(zero, F.flatten(F.transform(blocks, lambda b, k: F.transform(F.slice(plain(b), F.lit(2), F.size(b)), lambda x: x + F.get(offs, k))))))

    def all_of(a: Column) -> Column:
        n = F.size(a)
        blocks = F.transform(span(F.lit(0), F.expr("0") + F.floor((n - 1) / block)), lambda k: F.slice(a, (k * block + 1).cast("int"), F.lit(block)))
        return F.when(n <= block, plain(a)).otherwise(let(blocks, of_blocks))

    return let(values, all_of)


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): rows that repeat an id with another text keep apart, equal rows fall together."""
    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(named(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def on_row_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Joins on the row key; an absent id equals an absent id. The key columns come from the left."""
    r = right.withColumnsRenamed({"doc_id": "_r_id", "text_hash": "_r_hash"})
    return left.join(r, (left["doc_id"].eqNullSafe(r["_r_id"])) & (left["text_hash"] == r["_r_hash"]), how).drop("_r_id", "_r_hash")


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which the shuffle files of a query go when the query has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Writes a larger step's rows as a table beside the checkpoints, packed by column, and reads them back.

    The shuffles behind it are deleted with the end of the write: nothing later asks for them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored()`` once all that was made from them is itself stored, so that no lost task asks for them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, k, n, text, copies), and whether any id repeats. k is the id as a long, null without an id; of ids
    that are no whole numbers, a long in the ids' order.

    Rows of one id are told apart by n, their text's hash (0 where no id repeats); rows that repeat id and text are one
    row here, counted by copies. No window: rows of one id meet only where they hold the same text, and as partial sums.
    """
    d = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    if dict(d.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        d = d.withColumn("k", F.col("doc_id").cast("bigint"))
    else:  # ids of another type by their order: a number that grows with them, stored so that it stays what it is
        ids = d.select("doc_id").filter("doc_id is not null").distinct().sort("doc_id")
        d = d.join(stored(ids.withColumn("k", F.monotonically_increasing_id())), "doc_id", "left")
    d = d.select("doc_id", "k", "text")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    if d.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        return d.select("doc_id", "k", zero.alias("n"), "text", one.alias("copies")), False
    d = d.withColumn("n", F.xxhash64("text"))
    again = durable(d.filter("k is not null").groupBy("k", "n").count().filter("count > 1").select("k", "n"))
    alone = d.join(again, ["k", "n"], "left_anti").select("doc_id", "k", "n", "text", one.alias("copies"))
    together = d.join(again, ["k", "n"], "left_semi").groupBy("doc_id", "k", "n").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return alone.unionByName(together.select("doc_id", "k", "n", "text", "copies")), True
