"""Rates, quantiles, alerts and budgets over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_samples(events: DataFrame) -> DataFrame:
    """A running count per kind and minute, as a counter would expose it."""
    per = events.groupBy(F.col("event_type").alias("series"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("series").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("series", "at", total.alias("value"))


def counter_rate(samples: DataFrame, minutes: int = 60) -> DataFrame:
    """Increase a second within windows of some minutes; a falling counter counts from 0."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("at"))
    step = samples.withColumn("before", before)
    rise = F.when(F.col("before").isNull(), 0).when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    bucket = F.window(F.col("at").cast("timestamp"), f"{minutes} minutes")
    per = step.withColumn("rise", rise).groupBy("series", bucket.alias("w")).agg(F.sum("rise").alias("rise"))
    return per.select("series", F.col("w.start").cast("timestamp_ntz").alias("start"), F.round(F.col("rise") / (60.0 * minutes), 6).alias("rate"))


def success_ratio(events: DataFrame, bad: str = "error") -> DataFrame:
    per = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == bad).alias("bad"))
    return per.select("hour", F.round(1 - F.col("bad") / F.col("n"), 6).alias("ratio"))


def throughput_drop(events: DataFrame, share: float = 0.5) -> DataFrame:
    """Hours with less than a share of the count a day before."""
    per = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    day = per.select("event_type", (F.col("hour") + F.expr("interval 1 day")).alias("hour"), F.col("n").alias("before"))
    return per.join(day, ["event_type", "hour"]).where(F.col("n") < share * F.col("before"))


def lag_slope(events: DataFrame) -> DataFrame:
    """Change a second of the running count, by least squares within each day."""
    per = counter_samples(events).withColumn("day", F.to_date("at"))
    seconds = F.timestamp_diff("SECOND", F.col("day").cast("timestamp_ntz"), F.col("at")).cast("double")
    return per.groupBy("series", "day").agg(F.round(F.regr_slope(F.col("value").cast("double"), seconds), 6).alias("slope"))


def alerts_firing(events: DataFrame, threshold: float, least_hours: int) -> DataFrame:
    """Stretches of hours in a row whose error share is over a threshold, at least some hours long."""
    hot = success_ratio(events).where(F.col("ratio") < 1 - threshold)
    rank = F.row_number().over(Window.orderBy("hour"))
    n = F.timestamp_diff("HOUR", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour"))
    runs = hot.withColumn("run", n - rank).groupBy("run").agg(F.min("hour").alias("since"), F.count("*").alias("hours"))
    return runs.where(F.col("hours") >= least_hours).select("since", "hours")


def latency_percentiles(events: DataFrame, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest rank at round((n - 1) * p), over counts of distinct values."""
    w = Window.partitionBy("event_type")
    per = events.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    rows = per.select("event_type", "value", F.sum("n").over(w.orderBy("value")).alias("upto"), F.sum("n").over(w).alias("all"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p + 0.5), F.col("value"))).alias(f"p{round(p * 100)}")
    return rows.groupBy("event_type").agg(*[at(p) for p in shares])


def budget_regression(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """Median of a run against its bound, and against the base beyond noise (median absolute deviation)."""
    med = samples.groupBy("metric", "run").agg(F.median("v").alias("med"))
    dev = samples.join(med, ["metric", "run"]).groupBy("metric", "run").agg(F.first("med").alias("med"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    base = dev.where("run = 'base'").select("metric", F.col("med").alias("base"), F.col("mad").alias("base_mad"))
    now = dev.where("run = 'now'").select("metric", F.col("med").alias("now"), F.col("mad").alias("now_mad"))
    rows = budgets.join(base, "metric").join(now, "metric")
    band = F.greatest("floor_value", 3 * F.col("base_mad"), 3 * F.col("now_mad"), F.col("base") * F.col("pct") / 100)
    worse = F.when(F.col("direction") == "max", F.col("now") - F.col("base")).otherwise(F.col("base") - F.col("now"))
    broken = F.when(F.col("direction") == "max", F.col("now") > F.col("bound")).otherwise(F.col("now") < F.col("bound"))
    verdict = F.when(broken, "over_budget").when(worse > F.greatest(band, F.col("base") * F.col("tier_pct") / 100), "regressed").otherwise("ok")
    return rows.select("metric", "base", "now", F.round(band, 6).alias("band"), verdict.alias("verdict"))


def histogram_quantile(samples: DataFrame, q: float) -> DataFrame:
    """Linear within the bucket that holds the quantile; the last bucket gives its lower bound."""
    w = Window.partitionBy("grp").orderBy("le")
    rows = samples.select(
        "grp", "le", "n", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("before"), F.max("n").over(Window.partitionBy("grp")).alias("total")
    )
    goal = q * F.col("total")
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (goal - F.col("before")) / F.greatest(F.col("n") - F.col("before"), F.lit(1)))
    return rows.where((F.col("n") >= goal) & (F.col("before") < goal)).select("grp", F.round(value, 6).alias("value"))


def capacity_plan(plans: DataFrame) -> DataFrame:
    """Disk that an outage fills and seconds to catch up."""
    backlog = F.col("rate") * F.col("outage_s")
    spare = F.col("drain_rate") - F.col("rate")
    return plans.select("name", F.round(backlog * F.col("bytes_per_msg"), 6).alias("disk_bytes"), F.when(spare > 0, F.round(backlog / spare, 6)).alias("recovery_s"))


def tumbling_counts(events: DataFrame, minutes: int = 60) -> DataFrame:
    per = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def payload_group_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.get_json_object("payload", "$.k").alias("k")).agg(F.count("*").alias("n"), F.max(F.to_date("created_at")).alias("latest"))


def event_type_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"))


def date_partition_bounds(messages: DataFrame, strategy: str) -> DataFrame:
    """Name and bounds of the date partitions that messages fall into; strategy: day, week or month."""
    start = F.date_trunc(strategy, "created_at").cast("timestamp_ntz")
    end = start + F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[strategy])
    per = messages.groupBy(start.alias("from_ts"), end.alias("to_ts")).agg(F.count("*").alias("n"))
    return per.select(F.concat(F.lit("p"), F.date_format("from_ts", "yyyyMMdd")).alias("name"), "from_ts", "to_ts", "n")


def epoch(at: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
