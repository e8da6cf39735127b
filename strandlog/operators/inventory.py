"""Channel statistics, metrics, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import FULL_KINDS, channels
from .latest import latest_per_key


def status(total: Column, ingested: Column, is_member: Column, is_blocked: Column, refresh: Column) -> Column:
    """The first that holds of: blocked, unavailable, done (99 in 100), not_joined, not_started, in_progress."""
    return (
        F.when(is_blocked, "blocked").when(total.isNull() | refresh.isin("error", "unavailable"), "unavailable").when((total == 0) | (ingested * 100 >= total * 99), "done")
        .when((ingested == 0) & ~is_member, "not_joined").when(ingested == 0, "not_started").otherwise("in_progress")
    )


def channel_stats(log: DataFrame, counts: DataFrame, totals: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row for each channel of the channel list's log: name, totals, what is ingested, flags, creation day, status.

    ``counts`` (channel_id, ingested), ``totals`` (channel_id, total, refresh_status), ``blocked`` (channel_id): all by
    channel, so that joins share one partitioning; Spark broadcasts those that it finds small.
    """
    full = latest_per_key(log.filter(F.col("kind").isin(*FULL_KINDS)), ["channel_id"], [F.desc("off")]).select("channel_id", "created")
    j = channels(log).join(full, "channel_id", "left").join(totals, "channel_id", "left").join(counts, "channel_id", "left").join(blocked.select("channel_id", F.lit(True).alias("_b")), "channel_id", "left")
    ingested, member, is_blocked, refresh = F.coalesce("ingested", F.lit(0)).cast("bigint"), F.coalesce("is_member", F.lit(False)), F.coalesce("_b", F.lit(False)), F.coalesce("refresh_status", F.lit("unavailable"))
    day = F.date_from_unix_date(F.floor(F.col("created") / 86_400).cast("int")).cast("string")
    return j.select(
        "channel_id", F.coalesce("name", "channel_id").alias("name"), "total", ingested.alias("ingested"), member.alias("is_member"), F.coalesce("is_archived", F.lit(False)).alias("is_archived"),
        is_blocked.alias("is_blocked"), day.alias("created"), refresh.alias("refresh_status"), status(F.col("total"), ingested, member, is_blocked, refresh).alias("status"),
    )


def inventory_order(stats: DataFrame) -> DataFrame:
    """Unknown totals last, large ones first, then by name in any case, then id."""
    return stats.orderBy(F.col("total").isNull(), F.desc("total"), F.lower("name"), "channel_id")


def inventory_line(stats: DataFrame) -> DataFrame:
    """(channel_id, line): a row of a markdown table; pipes are escaped, thousands set apart, unknowns are dashes."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(c, r"\|", r"\\\\|"), r"[\r\n]+", " ")
    number = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit("—"))
    return stats.select("channel_id", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("name")), number("total"), number("ingested"), "status", F.coalesce("created", F.lit("—"))), F.lit(" |")).alias("line"))


def backfill_metrics(runs: DataFrame) -> DataFrame:
    """(channel_id, n_completed, n_aborted, in_progress): by the latest of each channel's starts and ends."""
    last = latest_per_key(runs.filter("kind in ('started', 'finished')"), ["channel_id"], [F.desc("id")]).select("channel_id", (F.col("kind") == "started").alias("in_progress"))
    n = runs.groupBy("channel_id").agg(F.count_if(F.col("outcome") == "completed").alias("n_completed"), F.count_if(F.col("outcome") == "aborted").alias("n_aborted"))
    return n.join(last, "channel_id")


def in_progress(runs: DataFrame, marked: DataFrame) -> DataFrame:
    """(channel_id, messages_so_far, first): channels whose latest event is a start or a page, in order; ``first``: marked by
    an operator, and so before the others."""
    last = latest_per_key(runs, ["channel_id"], [F.desc("id")]).filter("kind in ('started', 'page')")
    j = last.join(marked.select("channel_id", F.lit(True).alias("_m")), "channel_id", "left")
    return j.select("channel_id", F.when(F.col("kind") == "page", F.coalesce("messages", F.lit(0))).otherwise(0).cast("bigint").alias("messages_so_far"), F.coalesce("_m", F.lit(False)).alias("first")).orderBy(F.desc("first"), "channel_id")


def _anchors(runs: DataFrame) -> DataFrame:
    """(channel_id, run_id, last: struct of the run's last page): one aggregate for each run, then one for each channel's runs."""
    started = (F.col("kind") == "started") & ~F.coalesce("bounded", F.lit(False))
    page = F.col("kind") == "page"
    per = runs.groupBy("channel_id", "run_id").agg(
        F.max(F.when(started, F.col("id"))).alias("began"), F.max(F.when(F.col("kind") == "finished", F.col("id"))).alias("ended"),
        F.max_by(F.struct("has_more", "cursor"), F.when(page, F.struct("page", "id"))).alias("last"), F.max(page).alias("pages"),
    )
    # runs of a channel, the newest first; the last end is that of any run
    newest = W.partitionBy("channel_id").orderBy(F.desc_nulls_last("began"))
    waits = F.first(F.col("began").isNotNull() & ~F.col("pages") & F.col("ended").isNull()).over(newest)
    s = per.withColumn("last_end", F.coalesce(F.max("ended").over(W.partitionBy("channel_id")), F.lit(0))).withColumn("n", F.row_number().over(newest)).withColumn("waits", waits)
    fits = F.col("began").isNotNull() & F.col("pages") & F.col("ended").isNull() & ((F.col("n") == 1) | (F.col("waits") & (F.col("began") > F.col("last_end"))))
    return s.filter(fits).groupBy("channel_id").agg(F.min_by(F.struct("run_id", "last"), "n").alias("x")).select("channel_id", "x.*")


def resume_anchor(runs: DataFrame) -> DataFrame:
    """(channel_id, run_id): the run to go on with, of runs without a lower bound. The latest, if it has pages and no end;
    if it has neither, the latest before it with pages and no end that is newer than the channel's last end."""
    return _anchors(runs).select("channel_id", "run_id")


def resume_plan(runs: DataFrame) -> DataFrame:
    """(channel_id, run_id, history_done, history_cursor): where the anchored run's walk stopped."""
    done = ~F.col("last.has_more") | (F.coalesce("last.cursor", F.lit("")) == "")
    return _anchors(runs).select("channel_id", "run_id", done.alias("history_done"), F.when(done, "").otherwise(F.col("last.cursor")).alias("history_cursor"))


def run_outcomes(runs: DataFrame, most: int) -> DataFrame:
    """(channel_id, run_id, total, stopped_at, outcome): pages add up; a run is cut at the page that reaches ``most``."""
    w = W.partitionBy("channel_id", "run_id").orderBy("page", "id").rowsBetween(W.unboundedPreceding, 0)
    p = runs.filter("kind = 'page'").withColumn("sum", F.sum("messages").over(w))
    cut = p.groupBy("channel_id", "run_id").agg(F.min(F.when(F.col("sum") >= most, F.col("sum"))).alias("cut"), F.max("sum").alias("total"), F.min(F.when(F.col("sum") >= most, F.col("page"))).alias("stopped_at"))
    return cut.select("channel_id", "run_id", F.coalesce("cut", "total").cast("bigint").alias("total"), "stopped_at", F.when(F.col("cut").isNotNull(), "size_capped").otherwise("completed").alias("outcome"))


def walk_marks(runs: DataFrame, warn_at: int, every: int, most: int) -> DataFrame:
    """(channel_id, run_id, page, mark, messages): what is announced while pages of a run are written.

    ``aborted`` at the first page that would take the run beyond ``most`` messages: neither it nor a later one is written.
    ``warn_large`` once, at the first written page by which the run has ``warn_at`` messages. ``progress`` at each written page by
    which it has ``every`` more than at the last progress, so that a large page moves all later marks.

    Only pages of messages within the cap reach the fold over a run, so that its group is bounded by ``most``.
    """
    w = W.partitionBy("channel_id", "run_id").orderBy("page", "id").rowsBetween(W.unboundedPreceding, 0)
    p = runs.filter("kind = 'page'").withColumn("n", F.coalesce("messages", F.lit(0))).withColumn("sum", F.sum("n").over(w))
    kept = (F.col("sum") <= most) & (F.col("n") > 0)
    # all marks of a run come of one aggregate over its pages, as the window left them
    per = p.groupBy("channel_id", "run_id").agg(
        F.min(F.when(F.col("sum") > most, F.struct("page", "id", (F.col("sum") - F.col("n")).alias("messages")))).alias("ended"),
        F.min(F.when(kept & (F.col("sum") >= warn_at), F.struct("page", "id", F.col("sum").alias("messages")))).alias("warned"),
        F.sort_array(F.collect_list(F.when(kept, F.struct("page", "id", "sum")))).alias("pages"),
    )
    none = F.expr("cast(array() as array<struct<page:bigint,messages:bigint>>)")
    start = F.struct(F.lit(0).cast("bigint").alias("last"), none.alias("marks"))
    step = lambda s, x: F.when(x["sum"] >= s["last"] + every, F.struct(x["sum"].alias("last"), F.concat(s["marks"], F.array(F.struct(x["page"].cast("bigint").alias("page"), x["sum"].alias("messages")))).alias("marks"))).otherwise(s)
    mark = lambda name, x: F.struct(x["page"].cast("bigint").alias("page"), F.lit(name).alias("mark"), x["messages"].cast("bigint").alias("messages"))
    one = lambda name: F.when(F.col(name[1]).isNotNull(), F.array(mark(name[0], F.col(name[1])))).otherwise(F.array().cast("array<struct<page:bigint,mark:string,messages:bigint>>"))
    told = F.transform(F.aggregate("pages", start, step)["marks"], lambda x: mark("progress", x))
    return per.select("channel_id", "run_id", F.inline(F.concat(one(("aborted", "ended")), one(("warn_large", "warned")), told)))


def unique_slugs(df: DataFrame, root: str, slug: str, first: list[Column], id_col: str) -> DataFrame:
    """Adds ``unique_slug``: later rows of a root with one slug get -2, -3, ..., in the order ``first``."""
    n = F.row_number().over(W.partitionBy(root, slug).orderBy(*first, F.col(id_col)))
    return df.withColumn("unique_slug", F.when(n > 1, F.concat(F.col(slug), F.lit("-"), n)).otherwise(F.col(slug)))


def conversation_root(is_im: Column, is_mpim: Column, is_member: Column) -> Column:
    return F.when(is_im, "dms").when(is_mpim, "group-dms").when(is_member, "channels").otherwise("other-channels")
