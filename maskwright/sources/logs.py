"""Files and tables: the encrypted audit log, payload tables with quarantine, reports, trials, captures."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, evaluate, sync
from . import keys
from .staging import drop_staged, staged

log = logging.getLogger(__name__)
RECORD = "version int, iv string, authTag string, ciphertext string"
EVENT = "category string, value_hash string, ts string, session_id string"


def append_audit(events: DataFrame, path: str, key: Column) -> None:
    """Append events to the log, one sealed JSON record each."""
    audit.encrypted(events.select("category", "value_hash", "ts", "session_id"), key).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, key: Column) -> DataFrame:
    """All events of the log; no log gives no events. A broken record is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], EVENT)
    return audit.decrypted(spark.read.schema(RECORD).json(path), key, EVENT)


def record_then_sync(events: DataFrame, record, send) -> None:
    """Record, then send. A failed record is logged and nothing is sent; a failed send is a warning."""
    try:
        record(events)
    except Exception:
        log.exception("events weren't recorded; they aren't sent")
        return
    try:
        send(events)
    except Exception:
        log.warning("recorded events weren't sent", exc_info=True)


def ingest_payloads(payloads: DataFrame, accepted: str, quarantine: str) -> None:
    """Append valid payloads as rows and all others, with the rule they break, to the quarantine."""
    judged = staged(sync.validated(payloads), "judged")
    sync.stored_rows(judged.filter("error IS NULL")).write.mode("append").parquet(accepted)
    judged.filter("error IS NOT NULL").write.mode("append").parquet(quarantine)
    drop_staged(judged)


def write_jdbc(rows: DataFrame, url: str, table: str = "sync_payloads", **options: str) -> None:
    """Append payload rows to a database."""
    rows.withColumn("id", F.uuid()).withColumn("created_at", F.current_timestamp()).write.mode("append").options(**options).jdbc(url, table)


PAYLOAD_TABLE = (
    "id string, repo_label string, session_label string, captured_at string, period_start string, period_end string, payload_json string, created_at timestamp"
)


def store_format(url: str | None, hosted: bool = False) -> str:
    """``jdbc`` for a database's URL, else a local ``parquet`` store, which a hosted process can't have."""
    if url:
        return "jdbc"
    if hosted:
        raise ValueError("a hosted process needs a database")
    return "parquet"


def ingest_request(payloads: DataFrame, supplied: str, expected: str, accepted: str, quarantine: str) -> int:
    """The ingest endpoint's status: 401 for a wrong token, 400 if any payload is invalid, else 202."""
    if not keys.authorized(supplied, expected):
        return 401
    ingest_payloads(payloads, accepted, quarantine)
    return 400 if sync.validated(payloads).filter("error IS NOT NULL").limit(1).count() else 202


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored payloads in order of their time."""
    return sync.scanned(spark.read.parquet(path))


def send_payloads(payloads: DataFrame, post: Callable[[str], int]) -> int:
    """Payloads handed to the caller's own transport one by one; none gives no call, a status that isn't
    2xx is an error. Returns how many were sent."""
    sent = 0
    for row in payloads.select("payload_json").toLocalIterator():
        status = post(row["payload_json"])
        if not 200 <= status < 300:
            raise RuntimeError(f"the receiver answered {status}")
        sent += 1
    return sent


def json_line(level: Column, event: Column, **fields: Column) -> Column:
    """A structured log line."""
    return F.to_json(F.struct(level.alias("level"), event.alias("event"), *[c.alias(k) for k, c in fields.items()]))


def write_connection(path: str, url: str, token: str) -> None:
    """The connection's settings as a file that only its owner reads."""
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump({"url": url, "token": token}, f)


def read_connection(path: str) -> dict[str, str] | None:
    """The connection's settings; null if there are none or they are malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return None
    return held if isinstance(held, dict) and isinstance(held.get("url"), str) and isinstance(held.get("token"), str) else None


def write_pass_summary(trials: DataFrame, path: str) -> None:
    """One summary of a pass: rates by fixture."""
    evaluate.suspicion_rates(trials).coalesce(1).write.mode("overwrite").json(path)


def write_report(events: DataFrame, path: str) -> None:
    """The HTML report as one text file; the rows it shows are totals and a row a day."""
    page = audit.render_report(audit.summarize(events), audit.timeline(events))
    events.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_trials(trials: DataFrame, path: str) -> None:
    """Trial captures, a folder for each fixture."""
    trials.write.mode("append").partitionBy("fixture").json(path)


def capture_raw(batch: DataFrame, path: str, column: str = "value") -> None:
    """Raw responses as text; for use in ``foreachBatch``."""
    batch.select(F.col(column).cast("string")).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tuning array<string>, heldOut array<string>").option("multiLine", "true").json(path)


def read_requests(spark: SparkSession, path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Bodies of a folder of JSON lines as text, within the limit and beyond it."""
    raw = spark.read.text(path)
    return raw.filter(F.octet_length("value") <= limit), raw.filter(F.octet_length("value") > limit)
