"""Dashboard aggregates over payload rows with repo_label, session_label, captured_at and four totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def row_total() -> Column:
    """The sum of a row's categories."""
    out = F.col(P.CATEGORIES[0])
    for c in P.CATEGORIES[1:]:
        out = out + F.col(c)
    return out


def totals(payloads: DataFrame) -> DataFrame:
    """One row: sums of each category, sessions, repositories and the latest time."""
    return payloads.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in P.CATEGORIES],
        F.count_distinct("session_label").alias("sessions"),
        F.count_distinct("repo_label").alias("repos"),
        F.coalesce(F.max("captured_at"), F.lit("Waiting for first sync")).alias("latest"),
    )


def by_repo(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy("repo_label").agg(F.count_distinct("session_label").alias("sessions"), F.sum(row_total()).alias("total"), F.min("captured_at").alias("first_seen"))


def by_day(payloads: DataFrame) -> DataFrame:
    sums = payloads.groupBy(X.day(F.col("captured_at")).alias("day")).agg(*[F.sum(c).alias(c) for c in P.CATEGORIES])
    return sums.withColumn("total", row_total())


def top_days(days: DataFrame, n: int = 7) -> DataFrame:
    """The most recent days."""
    return days.orderBy(F.desc("day")).limit(n)


def repos_by_total(repos: DataFrame) -> DataFrame:
    """Repositories, largest first; ties by first sight. The share is of all repositories' total."""
    whole = repos.agg(F.sum("total").alias("whole"))  # one row
    return repos.crossJoin(F.broadcast(whole)).withColumn("share", X.percent(F.col("total"), F.col("whole"))).drop("whole").orderBy(F.desc("total"), "first_seen", "repo_label")


def category_shares(payloads: DataFrame) -> DataFrame:
    """A row for each category: its sum and share in per cent."""
    one = payloads.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in P.CATEGORIES])
    rows = one.withColumn("whole", row_total()).select("whole", F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("total")) for c in P.CATEGORIES])))
    return rows.select("category", "total", X.percent(F.col("total"), F.col("whole")).alias("share"))


def chart_ticks(days: DataFrame) -> DataFrame:
    """Five axis marks from 0 to the largest day, which counts as 1 at least."""
    top = days.agg(F.greatest(F.coalesce(F.max("total"), F.lit(0)), F.lit(1)).alias("top"))
    return top.select("top", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("i", F.col("top").alias("max_total"), (F.col("top") * F.col("i") / 4).alias("tick"))


def latest_by(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max(order).alias(order))
