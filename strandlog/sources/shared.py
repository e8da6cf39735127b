"""Tables that queries of one session share, in the folder that the session names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share; one of this machine's only where all is on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _seen(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files are still the same: their number and length, and when the table was last changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return (path,)
    sums = fs.getContentSummary(at)
    return path, sums.getLength(), sums.getFileCount(), fs.getFileStatus(at).getModificationTime()


_WRITTEN: dict[tuple, tuple[tuple, str, object]] = {}


def written_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], keys: list[str], tables: list[str]) -> DataFrame:
    """``make()`` as a table that the session writes once for each state of its source, sorted by ``keys`` and cut by their ranges.

    Filters on the keys then skip files and row groups, and every other column is read only where it is asked for. If
    the files of ``tables`` in ``source`` have changed, or the written table is gone, it is written anew.
    """
    at = (spark.sparkContext.applicationId, source, name)
    now = tuple(_seen(spark, f"{source}/{t}.parquet") for t in tables)
    kept = _WRITTEN.get(at)
    if kept is None or kept[0] != now or len(_seen(spark, kept[1])) == 1:
        df = make()
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        kept = _WRITTEN[at] = (now, path, df.schema)
    return spark.read.schema(kept[2]).parquet(kept[1])
