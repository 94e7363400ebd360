"""Dashboard aggregates of a library; every one is a single aggregate or a join with a small dense axis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.library import STATUSES, epoch_seconds, from_epoch

DATE_START = r"^\d{4}-\d{2}-\d{2}"


def date_seconds(text: Column | str) -> Column:
    """Midnight of a text that starts with a date, in seconds since 1970; else 0."""
    column = F.col(text) if isinstance(text, str) else text
    day = F.when(column.rlike(DATE_START), F.try_to_date(F.substring(column, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(F.unix_date(day).cast("bigint") * 86400, F.lit(0).cast("bigint"))


def intake_seconds() -> Column:
    """When a document arrived: its creation, else the start of its review, else 0."""
    return F.when(F.col("created_at") != 0, F.col("created_at")).otherwise(date_seconds("review_started"))


def month_key(seconds: str) -> Column:
    return F.date_format(from_epoch(seconds), "yyyy-MM")


def status_counts(rows: DataFrame) -> DataFrame:
    """Documents of each known status, and of all but archived ones (unknown statuses included)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.agg(F.count_if(F.col("status") != "archived").alias("all"), *counts)


def progress(rows: DataFrame) -> DataFrame:
    done, total = F.sum("sections_done"), F.sum("sections_total")
    return rows.agg(F.count(F.lit(1)).alias("documents"), done.alias("done"), total.alias("total"), F.when(total > 0, F.round(done / total * 100)).otherwise(0.0).cast("int").alias("percent"))


def rating_distribution(rows: DataFrame) -> DataFrame:
    """Ratings 5 to 1 with their documents, none left out, and each bar's share of the longest in percent (4 at least)."""
    axis = rows.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    counts = rows.where("rating > 0").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    dense = axis.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))
    top = dense.agg(F.greatest(F.lit(1), F.max("n")).alias("top"))
    return dense.join(F.broadcast(top)).select("rating", "n", F.greatest(F.lit(4.0), F.round(F.col("n") / F.col("top") * 100)).cast("int").alias("width"))


def monthly(rows: DataFrame, seconds: Column) -> DataFrame:
    """Documents of each month; the month of undated ones is null."""
    dated = rows.select(seconds.alias("s")).select(F.when(F.col("s") != 0, month_key("s")).alias("month"))
    return dated.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def month_axis(spark: SparkSession, as_of: date, months: int = 12) -> DataFrame:
    """The last so many months, this one included."""
    return spark.range(1).select(F.explode(F.sequence(F.add_months(F.trunc(F.lit(as_of), "MM"), 1 - months), F.trunc(F.lit(as_of), "MM"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def month_chart(rows: DataFrame, seconds: Column, as_of: date) -> DataFrame:
    """A dense axis with counts and bar heights: 2 for none, else 6 to 76 by share of the highest."""
    dense = month_axis(rows.sparkSession, as_of).join(monthly(rows, seconds).where("month IS NOT NULL"), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
    top = dense.agg(F.greatest(F.lit(1), F.max("n")).alias("top"))
    return dense.join(F.broadcast(top)).select("month", "n", F.when(F.col("n") == 0, 2.0).otherwise(F.greatest(F.lit(6.0), F.round(F.col("n") / F.col("top") * 76))).cast("int").alias("height"))


def exported(rows: DataFrame) -> DataFrame:
    return rows.withColumn("export_s", date_seconds("exported_at")).where((F.col("status") == "exported") | (F.col("export_s") != 0))


def median_lag(rows: DataFrame) -> DataFrame:
    """Median days from intake to export, over pairs in that order; an even number of pairs gives a rounded mean."""
    lag = exported(rows).withColumn("intake_s", intake_seconds()).where("intake_s <> 0 AND export_s <> 0 AND export_s >= intake_s")
    return lag.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.median(F.round((F.col("export_s") - F.col("intake_s")) / 86400))).cast("bigint").alias("median_days"))


def relative_time(seconds: Column, as_of: int) -> Column:
    """How long ago, in words; nothing for unknown times."""
    ago = F.lit(as_of) - seconds
    units = ((3600, 60, "m"), (86400, 3600, "h"), (7 * 86400, 86400, "d"), (30 * 86400, 7 * 86400, "w"), (365 * 86400, 30 * 86400, "mo"))
    text = F.when(seconds == 0, "").when(ago < 90, "just now")
    for limit, unit, name in units:
        text = text.when(ago < limit, F.concat(F.floor(ago / unit).cast("string"), F.lit(f"{name} ago")))
    return text.otherwise(F.concat(F.floor(ago / (365 * 86400)).cast("string"), F.lit("y ago")))


__all__ = ["date_seconds", "epoch_seconds", "exported", "intake_seconds", "median_lag", "month_axis", "month_chart", "month_key", "monthly", "progress", "rating_distribution", "relative_time", "status_counts"]
