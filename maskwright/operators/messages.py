"""Request bodies: unnesting, routing by tool, labels, joining results to calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

BLOCK = "type string, id string, name string, input map<string,string>, tool_use_id string, content string, text string"
BODY = "messages array<struct<role:string,content:string>>"


def parse_bodies(df: DataFrame, key: str, body: str = "body", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): bodies that are JSON objects within the byte limit, and all others with a reason."""
    raw = F.col(body)
    reason = F.when(raw.isNull(), "empty")
    if limit is not None:
        reason = reason.when(F.octet_length(raw) > limit, "too large")
    reason = reason.when(F.try_parse_json(raw).isNull(), "not json").when(F.json_object_keys(raw).isNull(), "not an object")
    judged = df.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def blocks(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """A row for each content block: message and block numbers, role and the block's fields. Content
    that is a string is one text block; anything that isn't a record is skipped."""
    messages = df.select(key, F.posexplode(F.from_json(F.get_json_object(body, "$.messages"), "array<string>")).alias("msg", "m"))
    # content is read from the raw message, where a string and an array can be told apart
    shaped = messages.select(key, "msg", F.get_json_object("m", "$.role").alias("role"), F.get_json_object("m", "$.content").alias("content"))
    listed = F.from_json("content", "array<string>")
    many = F.when(F.startswith("content", F.lit("[")) & listed.isNotNull(), listed).otherwise(
        F.when(F.col("content").isNotNull(), F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))))
    )
    rows = shaped.select(key, "msg", "role", F.posexplode(many).alias("block", "b")).filter(F.json_object_keys("b").isNotNull())
    return rows.select(key, "msg", "block", "role", F.from_json("b", BLOCK).alias("v")).select(key, "msg", "block", "role", "v.type", F.col("v.id").alias("call_id"), "v.name", "v.input", "v.tool_use_id", "v.content", "v.text")


def nested_text(content: Column) -> Column:
    """Text of a result's content: the string itself, or its text parts one after the other."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(F.startswith(content, F.lit("[")) & parts.isNotNull(), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")).otherwise(content)


def label(name: Column, path: Column, command: Column) -> Column:
    """The file's path, else the shell command's first 60 characters, else the tool's name."""
    return F.coalesce(F.when(path != "", path), F.when((name == "Bash") & (command != ""), F.concat(F.lit("Bash: "), X.truncate(command))), name)


def calls(rows: DataFrame, key: str) -> DataFrame:
    """The last call of each id with its label."""
    used = rows.filter("type = 'tool_use' AND call_id IS NOT NULL")
    place = F.struct("msg", "block")
    last = used.groupBy(key, F.col("call_id").alias("tool_use_id")).agg(F.max_by("name", place).alias("tool"), F.max_by("input", place).alias("args"))
    path, command = (F.try_element_at("args", F.lit(k)) for k in ("file_path", "command"))
    return last.select(key, "tool_use_id", "tool", label(F.col("tool"), path, command).alias("label"))


def results(rows: DataFrame, key: str) -> DataFrame:
    """Each result with its call's tool and label; one without a call is labelled by its own type."""
    found = rows.filter("type = 'tool_result'").select(key, "msg", "block", "tool_use_id", nested_text(F.col("content")).alias("text"))
    return found.join(calls(rows, key), [key, "tool_use_id"], "left").withColumn("label", F.coalesce("label", F.lit("tool_result")))


def routed(rows: DataFrame, key: str) -> DataFrame:
    """(key, msg, block, route, field, value): source fields of edits and writes go to ``code``, shell
    commands to ``names``, and results follow the tool that they answer. Empty values are left out."""
    used = rows.filter("type = 'tool_use'").withColumn("args", F.coalesce("input", F.create_map().cast("map<string,string>")))
    pick = lambda route, field: F.struct(F.lit(route).alias("route"), F.lit(field).alias("field"), F.try_element_at("args", F.lit(field)).alias("value"))
    options = (
        F.when(F.col("name") == "Edit", F.array(pick("code", "old_string"), pick("code", "new_string")))
        .when(F.col("name") == "Write", F.array(pick("code", "content")))
        .when(F.col("name") == "Bash", F.array(pick("names", "command")))
    )
    sent = used.select(key, "msg", "block", F.inline(options))
    back = results(rows, key).select(key, "msg", "block", F.when(F.col("tool") == "Bash", "names").otherwise("code").alias("route"), F.lit("result").alias("field"), F.col("text").alias("value"))
    return sent.unionByName(back).filter(F.length("value") > 0)


def chat_text(raw: Column) -> tuple[Column, Column]:
    """(text, error) of a chat response: the first choice's content, a string or an array of parts of
    which those of type ``text`` are joined."""
    choices = F.from_json(F.get_json_object(raw, "$.choices"), "array<string>")
    message = F.get_json_object(F.get(choices, 0), "$.message")
    content = F.get_json_object(message, "$.content")
    is_list = F.coalesce(F.rlike(message, F.lit(r'"content"\s*:\s*\[')), F.lit(False))
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")
    is_text = F.coalesce(F.rlike(message, F.lit(r'"content"\s*:\s*"')), F.lit(False))
    error = (
        F.when(F.try_parse_json(raw).isNull(), "invalid json").when(choices.isNull(), "no choices").when(F.json_object_keys(message).isNull(), "no message").when(~is_list & ~is_text, "no text content")
    )
    return F.when(error.isNull(), F.when(is_list, joined).otherwise(content)), error


def route_filter(method: Column, path: Column, enabled: bool = True) -> Column:
    """Requests that are transformed; absolute and protocol-relative targets never are."""
    return F.lit(enabled) & (method == "POST") & (F.regexp_replace(path, r"\?.*$", "") == "/v1/messages") & ~F.rlike(path, F.lit("(?i)^(https?:)?//"))
