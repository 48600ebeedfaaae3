"""Audit events: hashing, totals, timelines, reports, and the encrypted log's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

#: How event types of the event table stand for audit categories; others stay unknown.
EVENT_CATEGORIES = {"click": "identifier", "view": "comment", "purchase": "string", "signup": "secret"}


def audit_events(events: DataFrame) -> DataFrame:
    """(category, value_hash, ts, session_id) of the event table; ``ts`` is an ISO string."""
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_CATEGORIES.items() for x in kv]), F.col("event_type")), F.lit("unknown"))
    return events.select(
        category.alias("category"), F.sha2(F.col("event_id").cast("string"), 256).alias("value_hash"), X.iso(F.col("ts")).alias("ts"), F.col("user_id").cast("string").alias("session_id")
    )


def protected_events(transformed: DataFrame, session: str, at: Column) -> DataFrame:
    """Audit events of what a transformation has protected (its ``events``); ``at`` is their ISO time."""
    return transformed.select(F.col(session).cast("string").alias("session_id"), at.alias("ts"), F.explode("events").alias("e")).select("e.category", "e.value_hash", "ts", "session_id")


def known(category: Column) -> Column:
    return category.isin(*P.CATEGORIES)


def category_counts(category: str = "category") -> list[Column]:
    return [F.count_if(F.col(category) == c).alias(c) for c in P.CATEGORIES]


def summarize(events: DataFrame) -> DataFrame:
    """One row: totals, sessions and range. Unknown categories count for the range alone."""
    return events.agg(
        *category_counts(),
        F.count_distinct(F.when(known(F.col("category")), F.col("session_id"))).alias("sessions"),
        F.coalesce(F.substring(F.min("ts"), 1, 10), F.lit("no data")).alias("start"),
        F.coalesce(F.substring(F.max("ts"), 1, 10), F.lit("no data")).alias("end"),
    )


def timeline(events: DataFrame) -> DataFrame:
    """Counts of each known category by day."""
    return events.filter(known(F.col("category"))).groupBy(X.day(F.col("ts")).alias("day")).agg(*category_counts())


def stats_text(summary: DataFrame) -> DataFrame:
    """The summary as a line of text."""
    line = F.format_string(
        "%d identifiers, %d comments, %d strings, %d secrets across %d sessions (%s to %s)",
        *[F.col(c) for c in (*P.CATEGORIES, "sessions", "start", "end")],
    )
    return summary.select(line.alias("line"))


def render_report(summary: DataFrame, days: DataFrame, title: str = "Protection report") -> str:
    """An HTML report of one summary row and a row a day; everything is escaped."""
    import html

    s = summary.first().asDict()
    rows = "".join(
        f"<tr><td>{html.escape(r['day'])}</td>" + "".join(f"<td>{r[c]}</td>" for c in P.CATEGORIES) + "</tr>" for r in days.orderBy("day").collect()
    )
    cells = "".join(f"<div><strong>{s[c]}</strong><span>{c}</span></div>" for c in P.CATEGORIES)
    head = "".join(f"<th>{c.capitalize()}</th>" for c in P.CATEGORIES)
    empty = f'<tr><td colspan="{len(P.CATEGORIES) + 1}">No events recorded.</td></tr>'
    return (
        f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
        f"<p>{s['sessions']} sessions, {html.escape(s['start'])} to {html.escape(s['end'])}</p><div>{cells}</div>"
        f"<table><thead><tr><th>Date</th>{head}</tr></thead><tbody>{rows or empty}</tbody></table></body></html>"
    )


def encrypted(events: DataFrame, key: Column) -> DataFrame:
    """Records of the log: version, iv, authTag and ciphertext in base64. A fresh 12-byte vector each."""
    sealed = F.aes_encrypt(F.to_json(F.struct(*events.columns)), key, F.lit("GCM"))
    return events.select(sealed.alias("s")).select(
        F.lit(1).alias("version"),
        F.base64(F.substring("s", 1, 12)).alias("iv"),
        F.base64(F.expr("substring(s, octet_length(s) - 15, 16)")).alias("authTag"),
        F.base64(F.expr("substring(s, 13, octet_length(s) - 28)")).alias("ciphertext"),
    )


def decrypted(records: DataFrame, key: Column, schema: str) -> DataFrame:
    """Events of the log's records. Another version, a changed record or a wrong key is an error."""
    checked = F.when(F.col("version") == 1, F.concat(F.unbase64("iv"), F.unbase64("ciphertext"), F.unbase64("authTag"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown record version "), F.coalesce(F.col("version").cast("string"), F.lit("null")))).cast("binary")
    )
    plain = F.aes_decrypt(checked, key, F.lit("GCM")).cast("string")
    return records.select(F.from_json(plain, schema).alias("e")).select("e.*")
