"""Run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import work_folder

ACCURACY = 10_000  # of approximate percentiles: their rank is off by one in so many at most


def stage_summary(runs: DataFrame, status: str, items: str, seconds: str, ok: str = "ok", skipped: str = "skipped") -> DataFrame:
    """One row: counts by outcome, items and time, average items a success, the stage's status.

    A stage without attempts succeeded; one whose attempts all failed failed.
    """
    good, passed = F.col(status) == ok, F.col(status) == skipped
    s = runs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("succeeded"), F.count_if(passed).alias("skipped"), F.count_if(~good & ~passed).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col(items))), F.lit(0)).cast("double").alias("items"), F.coalesce(F.sum(seconds), F.lit(0)).cast("double").alias("seconds"),
    )
    return s.select(
        "total", "succeeded", "skipped", "failed", F.round("items", 4).alias("items"), F.round("seconds", 4).alias("seconds"), F.round(F.col("items") / F.greatest(F.col("succeeded"), F.lit(1)), 4).alias("items_each"),
        F.when((F.col("failed") > 0) & (F.col("succeeded") == 0), "FAILED").otherwise("COMPLETED").alias("status"),
    )


def benchmark(rows: DataFrame, group: str, value: str, success: str) -> DataFrame:
    """group, n, success_rate, mean, median, p95, most of the successful values.

    p95 is the value at place min(int(.95 n), n - 1) of the sorted values, and
    the median the mean of the middle two.  Approximate percentiles, whose
    error in rank is bounded, give each group a narrow range for either; the
    values below it are counted and only those inside are sorted (at most a
    few in ``ACCURACY`` of a group, or all of a small one), so the places are
    exact and no group is gathered.  Values are summed by group and compared
    as they are; null ones do not count as successes.
    """
    spark, path = rows.sparkSession, work_folder(rows.sparkSession)
    good = rows.where(F.col(success) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    margin = 4 / ACCURACY  # twice the error and what whole places add
    ends = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin), 0.95 - margin, min(1.0, 0.95 + margin)]
    bounds = good.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    whole = F.col("n") <= ACCURACY
    edges = [F.when(whole, F.col("least" if k % 2 == 0 else "most")).otherwise(F.get("q", F.lit(k))).alias(name) for k, name in enumerate(("lo50", "hi50", "lo95", "hi95"))]
    bounds.select("g", "n", "most", *edges).write.parquet(path)  # a row a group, read twice and the same both times
    bounds = spark.read.parquet(path)
    ranged = good.join(bounds.select(F.col("g").alias("of"), "lo50", "hi50", "lo95", "hi95"), F.col("g").eqNullSafe(F.col("of")))
    below = ranged.groupBy("g").agg(F.count_if(F.col("v") < F.col("lo50")).alias("b50"), F.count_if(F.col("v") < F.col("lo95")).alias("b95"))
    inside = lambda k: (F.col("v") >= F.col(f"lo{k}")) & (F.col("v") <= F.col(f"hi{k}"))
    counts = ranged.where(inside(50) | inside(95)).groupBy("g", "v", inside(50).alias("in50"), inside(95).alias("in95")).agg(F.count(F.lit(1)).alias("c"))
    upto = lambda k: F.sum(F.when(F.col(f"in{k}"), F.col("c")).otherwise(0)).over(Window.partitionBy("g").orderBy("v")).alias(f"upto{k}")
    sums_ = counts.select("g", "v", "in50", "in95", upto(50), upto(95)).join(below.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).drop("of")
    sums_ = sums_.join(bounds.select(F.col("g").alias("of"), "n"), F.col("g").eqNullSafe(F.col("of"))).drop("of")
    at = lambda k, place: F.min(F.when(F.col(f"in{k}") & (F.col(f"b{k}") + F.col(f"upto{k}") > place), F.col("v")))
    spots = sums_.groupBy("g").agg(at(95, F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1)).alias("p95"), ((at(50, F.floor((F.col("n") - 1) / 2)) + at(50, F.floor(F.col("n") / 2))) / 2).alias("median"))
    spots = spots.join(bounds.select(F.col("g").alias("of"), "most"), F.col("g").eqNullSafe(F.col("of"))).drop("of")
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(success).cast("double")), 3).alias("success_rate"), F.round(F.avg(F.when(F.col(success), F.col(value))), 3).alias("mean"))
    found = sums.join(spots, F.col(group).eqNullSafe(F.col("g")), "left")
    return found.select(group, "n", "success_rate", "mean", F.round("median", 3).alias("median"), F.round("p95", 3).alias("p95"), F.round("most", 3).alias("most"))


def cost(usage: DataFrame, rates: DataFrame, machine: str, hours: str, gigabytes: str, default_rate: float = 0.20, per_gb_month: float = 0.020) -> DataFrame:
    """One row: compute and storage cost; unknown machines have the default rate.

    Hours are summed by machine first, so few rows meet the rates; of several
    rates of one machine the largest counts.
    """
    used = usage.groupBy(machine).agg(F.sum(F.greatest(F.col(hours), F.lit(0.0))).alias("__hours"), F.sum(gigabytes).alias("__gb"))
    named = rates.groupBy(F.col(machine).alias("__machine")).agg(F.max("rate").alias("__rate"))
    rows = used.join(named, F.col(machine) == F.col("__machine"), "left")
    return rows.agg(F.round(F.sum(F.coalesce("__rate", F.lit(default_rate)) * F.col("__hours")), 4).alias("compute"), F.round(F.sum("__gb") * per_gb_month / 30, 4).alias("storage"))


def uptime_hours(begun: Column, ended: Column) -> Column:
    return (F.unix_seconds(ended.cast("timestamp")) - F.unix_seconds(begun.cast("timestamp"))) / 3600


def judged_cost(costs: DataFrame, publications: int, fair: float = 0.01, dear: float = 0.05) -> DataFrame:
    """``cost``'s row with the total, the cost a publication and its rating."""
    total = F.coalesce("compute", F.lit(0.0)) + F.coalesce("storage", F.lit(0.0))
    rows = costs.withColumn("total", F.round(total, 4)).withColumn("each", F.round(F.col("total") / max(1, publications), 6))
    return rows.withColumn("rating", F.when(F.col("each") <= fair, "good").when(F.col("each") <= dear, "fair").otherwise("dear"))


def scrape_stats(found: DataFrame, kept: DataFrame, files: str) -> DataFrame:
    """One row: entries found and kept, duplicates removed, file urls, and the shares with abstract, year and files."""
    n = found.agg(F.count(F.lit(1)).alias("found"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    some = F.coalesce(F.size(files), F.lit(0)) > 0
    s = kept.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.greatest(F.size(files), F.lit(0))), F.lit(0)).alias("files"), share(F.length("abstract") > 0).alias("with_abstract"), share(F.col("year").isNotNull()).alias("with_year"), share(some).alias("with_files"))
    return n.join(s, how="cross").select("found", "kept", (F.col("found") - F.col("kept")).alias("duplicates"), "files", "with_abstract", "with_year", "with_files")


def stage_counts(listing: DataFrame, path: str, stages: dict[str, str]) -> DataFrame:
    """stage, n: files whose path matches a stage's pattern; a stage without files has 0."""
    spark = listing.sparkSession
    named = F.coalesce(*[F.when(F.col(path).rlike(pattern), F.lit(stage)) for stage, pattern in stages.items()])
    counts = listing.groupBy(named.alias("stage")).agg(F.count(F.lit(1)).alias("n")).where("stage is not null")
    all_ = spark.createDataFrame([(s,) for s in stages], "stage string")
    return all_.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_pages(elements: DataFrame, document: str, page: str) -> DataFrame:
    """document, pages: how many distinct page numbers its elements have."""
    return elements.groupBy(document).agg(F.count_distinct(page).alias("pages"))


def measured(rows: DataFrame, text: str, seconds: str, error: str) -> DataFrame:
    """A benchmark row a file: seconds, characters, tokens, pages, success."""
    from ..functions.text import tokens
    from .chunking import page_spans

    body = F.coalesce(F.col(text), F.lit(""))
    return rows.select("*", F.length(body).alias("chars"), F.size(tokens(body)).alias("tokens"), F.size(page_spans(body)).alias("pages"), (F.col(error).isNull() & (F.length(body) > 0)).alias("success"))


def log_flags(lines: DataFrame, text: str) -> DataFrame:
    """n, errors, warnings, done of a log's lines."""
    low = F.lower(F.col(text))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(low.rlike("error|exception|traceback")).alias("errors"), F.count_if(low.contains("warning")).alias("warnings"), F.coalesce(F.max(low.rlike("completed|finished")), F.lit(False)).alias("done"))
