"""Inputs of the registered queries: texts, events, bodies and trials built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_events(table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"))


EVENTS_SQL = """SELECT coalesce(CASE event_type WHEN 'click' THEN 'identifier' WHEN 'view' THEN 'comment' WHEN 'purchase' THEN 'string' WHEN 'signup' THEN 'secret' END, 'unknown') AS category,
 sha256(event_id::VARCHAR) AS value_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, user_id::VARCHAR AS session_id FROM events"""


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload rows of each user and day."""
    e = audit_events(spark, sf_dir).filter(audit.known(F.col("category")))
    rows = e.groupBy("session_id", F.substring("ts", 1, 10).alias("d")).agg(*audit.category_counts(), F.max("ts").alias("captured_at"))
    return rows.select(
        F.concat(F.lit("repo_"), F.substring(F.sha2((F.col("session_id").cast("long") % 7).cast("string"), 256), 1, 16)).alias("repo_label"),
        F.concat(F.lit("session_"), F.substring(F.sha2("session_id", 256), 1, 16)).alias("session_label"), "captured_at", "identifier", "comment", "string", "secret",
    )


PAYLOADS_SQL = f"""SELECT 'repo_' || sha256((session_id::BIGINT % 7)::VARCHAR)[1:16] AS repo_label, 'session_' || sha256(session_id)[1:16] AS session_label,
 max(ts) AS captured_at, count(*) FILTER (category = 'identifier') AS identifier, count(*) FILTER (category = 'comment') AS comment,
 count(*) FILTER (category = 'string') AS string, count(*) FILTER (category = 'secret') AS secret
 FROM ({EVENTS_SQL}) WHERE category IN ('identifier', 'comment', 'string', 'secret') GROUP BY session_id, ts[1:10]"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies from conversations: user turns answer the call of the turn before."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tool = F.element_at(F.array(F.lit("Edit"), F.lit("Write"), F.lit("Bash")), (F.col("turn") % 3 + 1).cast("int"))
    args = F.create_map(
        F.lit("file_path"), F.when(tool == "Bash", "").otherwise(F.concat(F.lit("src/f"), F.col("conv_id").cast("string"), F.lit(".ts"))), F.lit("command"), F.when(tool == "Bash", F.col("text")).otherwise(""),
        F.lit("old_string"), F.when(tool == "Edit", F.col("text")).otherwise(""), F.lit("new_string"), F.when(tool == "Edit", F.concat(F.col("text"), F.lit("!"))).otherwise(""), F.lit("content"), F.when(tool == "Write", F.col("text")).otherwise(""),
    )
    call = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), tool.alias("name"), args.alias("input")))
    answer = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("tool_use_id"), F.col("text").alias("content")))
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")))
    block = F.when(F.col("role") == "assistant", call).otherwise(answer)
    shaped = F.when(F.col("role") == "system", plain).otherwise(F.concat(F.lit('{"role":"'), "role", F.lit('","content":['), block, F.lit("]}")))
    rows = c.select("conv_id", "turn", shaped.alias("m"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    return listed.select("conv_id", F.concat(F.lit('{"messages":['), F.array_join(F.col("ms.m"), ","), F.lit("]}")).alias("body"))


TURNS_SQL = """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg,
 CASE turn % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Write' ELSE 'Bash' END AS tool FROM conversations"""


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small source files from parts: a comment, an interface, constants, a function and a class."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    word = F.concat(F.lit("x"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.initcap(F.regexp_extract("p_name", r"^(\w+)", 1)))
    source = F.format_string(
        "// reads the %s of %s\nimport { load } from './%s';\ninterface Row { amount: number; ready: boolean; mode: 'slow' | 'fast' }\nconst note = \"stock of %s is being counted\";\n"
        "function %s(row: Row, rate: number): number {\n  const base = row.amount * %d;\n  let total = 0;\n  for (const k of [1, 2]) { total += k * rate; }\n"
        "  if (row.mode === 'slow') { return Math.max(base, total); }\n  return base - total;\n}\nexport class Book { add(row: Row) { return %s(row, 2); } }\n",
        "p_name", "p_brand", F.lower("p_type"), "p_name", word, "p_size", word,
    )
    return p.select("p_partkey", F.col("p_brand").alias("session"), F.concat(F.lit("src/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".ts")).alias("path"), source.alias("source"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials from labels: fixture, status and verdict."""
    y = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    status = F.when(F.col("doc_id") % 9 == 0, "failed").when(F.col("doc_id") % 8 == 7, "failed").otherwise("completed")
    return y.select(F.concat(F.lit("fixture-"), (F.col("doc_id") % 8).cast("string")).alias("fixture_path"), status.alias("status"), (F.col("toxic") == 1).alias("suspicious"))
