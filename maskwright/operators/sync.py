"""Aggregate payloads: building from events, closed-schema validation, storage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import audit

ROOT_KEYS = ("version", "repoLabel", "sessionLabel", "capturedAt", "period", "totals", "hashes")
PAYLOAD = (
    "version int, repoLabel string, sessionLabel string, capturedAt string, period struct<start:string,end:string>,"
    " totals struct<identifier:bigint,comment:bigint,string:bigint,secret:bigint>, hashes array<struct<category:string,valueHash:string,timestamp:string>>"
)


def payload_parts(events: DataFrame, repo: Column) -> DataFrame:
    """A row for each repository and session: labels, period and totals. ``repo`` is an expression of
    the events. The session's id is required, never made up."""
    keyed = events.filter(audit.known(F.col("category"))).withColumn("__repo", repo)
    return (
        keyed.groupBy("__repo", "session_id")
        .agg(*audit.category_counts(), F.min("ts").alias("period_start"), F.max("ts").alias("period_end"))
        .select(X.pseudonymous_label("repo", F.col("__repo")).alias("repo_label"), X.pseudonymous_label("session", F.col("session_id")).alias("session_label"), "period_start", "period_end", *P.CATEGORIES)
    )


def build_payloads(events: DataFrame, repo: Column, captured_at: Column) -> DataFrame:
    """Payload JSON of each repository and session, split into parts of at most ``MAX_HASHES`` hashes,
    so no payload and no group grows without bound."""
    from pyspark.sql import Window

    keyed = events.filter(audit.known(F.col("category"))).withColumn("__repo", repo)
    # places in a session from two levels, a running count of its days and a number within a day
    days = keyed.groupBy("__repo", "session_id", X.day(F.col("ts")).alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__repo", "session_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    starts = days.withColumn("__first", F.coalesce(before, F.lit(0))).drop("__n")
    within = Window.partitionBy("__repo", "session_id", "__day").orderBy("ts", "value_hash", "category")
    placed = keyed.withColumn("__day", X.day(F.col("ts"))).join(starts, ["__repo", "session_id", "__day"])
    parts = placed.withColumn("part", F.floor((F.col("__first") + F.row_number().over(within) - 1) / P.MAX_HASHES))
    grouped = parts.groupBy("__repo", "session_id", "part").agg(
        *audit.category_counts(), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.array_sort(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "category", F.col("value_hash").alias("valueHash")))).alias("h"),
    )
    body = F.struct(
        F.lit(1).alias("version"), X.pseudonymous_label("repo", F.col("__repo")).alias("repoLabel"), X.pseudonymous_label("session", F.col("session_id")).alias("sessionLabel"),
        captured_at.alias("capturedAt"), F.struct("start", "end").alias("period"), F.struct(*P.CATEGORIES).alias("totals"),
        F.transform("h", lambda x: F.struct(x["category"].alias("category"), x["valueHash"].alias("valueHash"), x["timestamp"].alias("timestamp"))).alias("hashes"),
    )
    return grouped.select(F.to_json(body).alias("payload_json"))


def _only_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(json)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0)


def _time(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(P.ISO_TIME)) & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def validated(df: DataFrame, column: str = "payload_json") -> DataFrame:
    """``df`` with ``error``: null for a valid payload, else the first rule it breaks. The schema is closed."""
    j = F.col(column)
    get = lambda path: F.get_json_object(j, path)
    count = lambda c: get(f"$.totals.{c}")
    totals_ok = F.lit(True)
    for c in P.CATEGORIES:
        totals_ok = totals_ok & F.coalesce(F.rlike(count(c), F.lit(r"^\d+$")) & count(c).try_cast("long").between(0, P.MAX_COUNT), F.lit(False))
    hashes = F.from_json(get("$.hashes"), "array<string>")
    hash_ok = F.forall(
        hashes,
        lambda h: _only_keys(h, ("category", "valueHash", "timestamp"))
        & F.coalesce(F.get_json_object(h, "$.category").isin(*P.CATEGORIES), F.lit(False))
        & F.coalesce(F.rlike(F.get_json_object(h, "$.valueHash"), F.lit(P.VALUE_HASH)), F.lit(False))
        & _time(F.get_json_object(h, "$.timestamp")),
    )
    rule = lambda ok: ~F.coalesce(ok, F.lit(False))
    error = (
        F.when(rule(_only_keys(j, ROOT_KEYS)), "shape")
        .when(rule((get("$.version") == "1") & F.rlike(get("$.repoLabel"), F.lit(P.REPO_LABEL)) & F.rlike(get("$.sessionLabel"), F.lit(P.SESSION_LABEL))), "identity")
        .when(rule(_time(get("$.capturedAt")) & _only_keys(get("$.period"), ("start", "end"))), "timestamps")
        .when(rule(_time(get("$.period.start")) & _time(get("$.period.end"))), "period")
        .when(rule(_only_keys(get("$.totals"), P.CATEGORIES)), "totals")
        .when(rule(totals_ok), "total")
        .when(rule(hashes.isNotNull() & (F.size(hashes) <= P.MAX_HASHES)), "hashes")
        .when(rule(hash_ok), "hash contents")
    )
    return df.withColumn("error", error)


def stored_rows(payloads: DataFrame, column: str = "payload_json") -> DataFrame:
    """Rows of the payload table: labels and times beside the whole JSON."""
    p = payloads.withColumn("p", F.from_json(column, PAYLOAD))
    return p.select(
        F.col("p.repoLabel").alias("repo_label"), F.col("p.sessionLabel").alias("session_label"), F.col("p.capturedAt").alias("captured_at"),
        F.col("p.period.start").alias("period_start"), F.col("p.period.end").alias("period_end"), F.col(column).alias("payload_json"),
    )


def scanned(rows: DataFrame) -> DataFrame:
    """Stored payloads in order of their time, then of its text."""
    return rows.orderBy(F.try_to_timestamp("captured_at"), "captured_at").withColumn("payload", F.from_json("payload_json", PAYLOAD))
