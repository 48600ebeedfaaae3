"""More registered queries: operators of requests, stores, evaluation, streams and code, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import audit, code, dashboard, evaluate, mapping, messages, numbering, pii, rehydrate, requests, sync
from ..sources import keys, logs
from ..sources.staging import shared_root
from ..streaming import frames as S
from . import shapes
from . import tables as T
from .queries import _CATS, _IN, _LETTER_SQL, _names_sql, _quoted, _spans_sql, _sql_list, query


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_root(spark)}/maskwright/{name}-{uuid.uuid4().hex}"


# ---- code, by golden texts of six shapes


@query(f"SELECT p_partkey, {shapes.sql(shapes.RENAMED)} AS output, p_partkey % 6 <> 5 AS changed, {shapes.number_sql([c[0] for c in shapes.COUNTS])} AS comments, {shapes.number_sql([c[1] for c in shapes.COUNTS])} AS strings, {shapes.number_sql([c[2] for c in shapes.COUNTS])} AS constants FROM part")
def code_shapes(spark, sf):
    """Files renamed and redacted, each a session of its own."""
    out = code.obfuscate_files(shapes.files(spark, sf), "session", "path", "source")
    return out.select(F.col("session").cast("long").alias("p_partkey"), "output", "changed", "comments", "strings", "constants")


@query(f"SELECT p_partkey, {shapes.sql(shapes.RESTORED)} AS restored FROM part")
def code_shapes_restored(spark, sf):
    """The renamed files with their names put back: shorthands fold, redactions stay."""
    out = code.obfuscate_files(shapes.files(spark, sf), "session", "path", "source")
    back = F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    return out.select(F.col("session").cast("long").alias("p_partkey"), rehydrate.restore_column(F.col("output"), back).alias("restored"))


@query(f"SELECT p_partkey, {shapes.sql(shapes.DISGUISED)} AS output, nullif({shapes.sql(shapes.DOMAINS)}, '') AS domain, {shapes.sql(shapes.SOURCES)} AS restored FROM part")
def code_shapes_disguised(spark, sf):
    """Whole files in disguise, and restored from it."""
    out = code.disguise_files(shapes.files(spark, sf), "p_partkey", "source")
    return out.select("p_partkey", "output", F.when(F.col("valid"), F.col("domain")).alias("domain"), "restored")


@query(" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS part, {shapes.number_sql([s[i] if s else 0 for s in shapes.SHAPES])} AS n FROM part WHERE p_partkey % 6 <> 5" for i, k in enumerate(code.SHAPE)))
def code_shape_counts(spark, sf):
    return code.shapes_of(shapes.files(spark, sf), "p_partkey", "source")


@query(f"SELECT category, sha256(value) AS value_hash, '2024-01-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS ts, p_brand AS session_id FROM ({shapes.hidden_sql()})")
def request_events(spark, sf):
    """Audit events of what whole requests protect: each file is a request that writes it."""
    return _request_events(spark, sf)


def _bodies(spark, sf):
    f = shapes.files(spark, sf)
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("t1").alias("id"), F.lit("Write").alias("name"), F.struct(F.col("path").alias("file_path"), F.col("source").alias("content")).alias("input"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content"))).alias("messages")))
    return f.select("p_brand", "p_partkey", body.alias("body"))


def _request_events(spark, sf):
    out = requests.transform_bodies(_bodies(spark, sf), "p_brand", "p_partkey")
    day = F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0")
    return audit.protected_events(out, "p_brand", F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00.000Z")))


_EVENTS = f"(SELECT category, '2024-01-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS ts, p_brand AS session_id FROM ({shapes.hidden_sql()}))"


@query(f"""WITH s AS (SELECT session_id, {_CATS}, max(ts) AS captured_at FROM {_EVENTS} GROUP BY 1)
SELECT sum(identifier)::BIGINT AS identifier, sum(comment)::BIGINT AS comment, sum(string)::BIGINT AS string, sum(secret)::BIGINT AS secret, count(*) AS sessions, 1::BIGINT AS repos, max(captured_at) AS latest FROM s""")
def request_dashboard(spark, sf):
    """From requests over the sealed log and stored payloads to the dashboard's totals."""
    path, key = _folder(spark, "audit-log"), F.lit(bytes(range(32)))
    logs.append_audit(_request_events(spark, sf), path, key)
    events = logs.read_audit(spark, path, key)
    parts = sync.payload_parts(events, F.lit("repo")).withColumn("captured_at", F.col("period_end"))
    return dashboard.totals(parts)


@query(f"""SELECT p_brand AS session, count(*) AS requests, sum({shapes.number_sql([c[3] for c in shapes.COUNTS])})::BIGINT AS names, sum({shapes.number_sql([c[0] for c in shapes.COUNTS])})::BIGINT AS comments,
 sum({shapes.number_sql([c[1] for c in shapes.COUNTS])})::BIGINT AS strings, sum({shapes.number_sql([c[2] for c in shapes.COUNTS])})::BIGINT AS constants FROM part GROUP BY 1""")
def request_stats(spark, sf):
    out = requests.transform_bodies(_bodies(spark, sf), "p_brand", "p_partkey")
    return requests.stats(out, "p_brand").select(F.col("p_brand").alias("session"), "requests", "names", "comments", "strings", "constants")


@query(f"SELECT p_brand AS session, list_sort(list(DISTINCT {shapes.sql(shapes.DOMAINS)}) FILTER (p_partkey % 6 <> 5))::VARCHAR AS domains FROM part GROUP BY 1")
def request_domains(spark, sf):
    """Domains that a session's requests use where whole files are disguised."""
    out = requests.stats(requests.transform_bodies(_bodies(spark, sf), "p_brand", "p_partkey", mode="coherent"), "p_brand")
    return out.select(F.col("p_brand").alias("session"), F.concat(F.lit("["), F.array_join("domains", ", "), F.lit("]")).alias("domains"))


_KINDS = tuple(mapping.POOL_STEMS)


@query(" UNION ALL ".join(
    f"SELECT p_partkey, '{k}' AS kind, {t} AS theme, ({_sql_list(mapping.pooled_names(k, t))})[((p_partkey - 1) % {len(mapping.pooled_names(k, t))} + 1)::INTEGER] || CASE WHEN p_partkey <= {len(mapping.pooled_names(k, t))} THEN '' ELSE lower(to_base((p_partkey - 1) // {len(mapping.pooled_names(k, t))} + 1, 36)) END AS name FROM part WHERE p_partkey > 0"
    for k in _KINDS for t in (0, 2)))
def pooled_names(spark, sf):
    """Names of each kind's pool under two themes, past the pool's end with a number."""
    p = T.table(spark, sf, "part", "p_partkey").filter("p_partkey > 0")
    rows = p.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in _KINDS])))
    out = [rows.select("p_partkey", "kind", F.lit(t).alias("theme"), mapping.pooled_name(F.col("kind"), F.col("p_partkey"), t).alias("name")) for t in (0, 2)]
    return out[0].unionByName(out[1])


@query(f"SELECT p_partkey, {shapes.sql(shapes.STEALTH)} AS output FROM part")
def code_shapes_stealth(spark, sf):
    """Names from pools, counted by kind and role."""
    out = code.obfuscate_files(shapes.files(spark, sf), "session", "path", "source", style="stealth")
    return out.select(F.col("session").cast("long").alias("p_partkey"), "output")


@query(f"SELECT * FROM ({shapes.declarations_sql()})")
def code_declarations(spark, sf):
    """Kinds and roles of declarations."""
    return code.declarations_of(shapes.files(spark, sf), "p_partkey", "source")


@query(f"SELECT p_partkey, p_partkey % 6 NOT IN (0, 5) AS changed, CASE WHEN p_partkey % 6 IN (0, 5) THEN {shapes.sql(shapes.SOURCES)} ELSE {shapes.sql(shapes.RENAMED)} END AS output FROM part")
def code_size_guard(spark, sf):
    """Files of more than eight lines pass through untouched, as do those that don't scan."""
    out = code.obfuscate_files(shapes.files(spark, sf), "session", "path", "source", max_lines=8)
    return out.select(F.col("session").cast("long").alias("p_partkey"), "changed", "output")


@query("SELECT p_partkey::VARCHAR AS session, unnest(['a.ts', 'b.ts', 'c.ts']) AS path, unnest(['const var_1 = ' || p_size || ';', 'use(var_1, other);', 'const broken = (;']) AS output FROM part")
def code_known_names(spark, sf):
    """A name that a file doesn't declare is one of its session's, if the session knows it."""
    p = T.table(spark, sf, "part", "p_partkey", "p_size")
    name = F.concat(F.lit("rate"), F.col("p_partkey").cast("string"))
    rows = [("a.ts", F.concat(F.lit("const "), name, F.lit(" = "), F.col("p_size").cast("string"), F.lit(";"))), ("b.ts", F.concat(F.lit("use("), name, F.lit(", other);"))), ("c.ts", F.lit("const broken = (;"))]
    files = p.select(F.col("p_partkey").cast("string").alias("session"), F.inline(F.array(*[F.struct(F.lit(a).alias("path"), s.alias("source")) for a, s in rows])))
    return code.obfuscate_files(files, "session", "path", "source").select("session", "path", "output")


# ---- requests and their bounds

_METHOD = "CASE event_type WHEN 'click' THEN 'GET' ELSE 'POST' END"
_TARGET = "CASE event_id % 5 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/v1/messages?beta=' || user_id WHEN 2 THEN '//host' || user_id || '/v1/messages' WHEN 3 THEN 'HTTPS://u@h' || user_id || '.org/v1/messages?k=1#x' ELSE '/v1/models' END"


def _targets(spark, sf):
    e = T.table(spark, sf, "events", "event_id", "user_id", "event_type")
    u = F.col("user_id").cast("string")
    k = F.col("event_id") % 5
    target = F.when(k == 0, "/v1/messages").when(k == 1, F.concat(F.lit("/v1/messages?beta="), u)).when(k == 2, F.concat(F.lit("//host"), u, F.lit("/v1/messages"))).when(k == 3, F.concat(F.lit("HTTPS://u@h"), u, F.lit(".org/v1/messages?k=1#x"))).otherwise("/v1/models")
    return e.select("event_id", F.when(F.col("event_type") == "click", "GET").otherwise("POST").alias("method"), target.alias("target"), (200 + F.col("event_id") % 3).cast("int").alias("status"), F.col("user_id").cast("int").alias("names"), F.lit(7).alias("ms"))


@query(f"SELECT event_id, {_METHOD} = 'POST' AND event_id % 5 IN (0, 1) AS is_transformed FROM events")
def request_routes(spark, sf):
    """Which requests are transformed: posts of messages, to a target without a host."""
    return _targets(spark, sf).select("event_id", messages.route_filter(F.col("method"), F.col("target")).alias("is_transformed"))


@query(f"""SELECT event_id, {_METHOD} || ' ' || CASE event_id % 5 WHEN 4 THEN '/v1/models' ELSE '/v1/messages' END || ' -> ' || (200 + event_id % 3) || ', ' || user_id || ' names, 7 ms' AS line,
 CASE event_id % 5 WHEN 3 THEN 'https://h' || user_id || '.org/v1/messages' ELSE '[invalid URL]' END AS shown, '{{"level":"info","event":"exchange","status":' || (200 + event_id % 3) || '}}' AS json FROM events""")
def request_log(spark, sf):
    """Lines of the exchange log, for people and as JSON."""
    t = _targets(spark, sf)
    return t.select("event_id", requests.marker("method", "target", "status", "names", "ms").alias("line"), X.url_display(F.col("target")).alias("shown"), logs.json_line(F.lit("info"), F.lit("exchange"), status=F.col("status")).alias("json"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'empty' WHEN strlen(b) > 600 THEN 'too large' WHEN turn % 4 = 1 THEN 'not json' WHEN turn % 4 = 2 THEN 'not an object' END AS reason FROM (
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"t":' || to_json(text) || '}' WHEN 1 THEN '{"t":' || to_json(text) WHEN 2 THEN '[' || to_json(text) || ']' END AS b FROM conversations)""")
def request_bounds(spark, sf):
    """Bodies within the limit that are objects, and all others with the reason."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "text")
    t = F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$.t")
    k = F.col("turn") % 4
    body = F.when(k == 0, F.concat(F.lit('{"t":'), F.regexp_replace(t, r"^\[|\]$", ""), F.lit("}"))).when(k == 1, F.concat(F.lit('{"t":'), F.regexp_replace(t, r"^\[|\]$", ""))).when(k == 2, t)
    good, bad = messages.parse_bodies(c.withColumn("body", body), "conv_id", limit=600)
    return good.select("conv_id", "turn", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("conv_id", "turn", "reason"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 6 IN (0, 1) THEN text END AS text, CASE turn % 6 WHEN 2 THEN 'no choices' WHEN 3 THEN 'no message' WHEN 4 THEN 'no text content' WHEN 5 THEN 'invalid json' END AS error FROM conversations""")
def chat_responses(spark, sf):
    """A chat response's text: a string, or parts of which only texts count."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "text")
    t, k = F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$.t"), F.col("turn") % 6
    t = F.regexp_replace(t, r"^\[|\]$", "")
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), t, F.lit("}}]}")))
        .when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"image"},{"type":"text","text":'), t, F.lit("}]}}]}")))
        .when(k == 2, F.concat(F.lit('{"other":'), t, F.lit("}"))).when(k == 3, F.concat(F.lit('{"choices":['), t, F.lit("]}")))
        .when(k == 4, F.lit('{"choices":[{"message":{"role":"assistant"}}]}')).otherwise("not json")
    )
    text, error = messages.chat_text(F.col("body"))
    return c.withColumn("body", body).select("conv_id", "turn", text.alias("text"), error.alias("error"))


# ---- stores and payloads

_STORED = f"""SELECT 'repo_' || sha256('repo-' || (session_id::BIGINT % 7))[1:16] AS repo_label, 'session_' || sha256(session_id)[1:16] AS session_label, '2024-02-' || lpad((1 + session_id::BIGINT % 28)::VARCHAR, 2, '0') || 'T00:00:00.000Z' AS captured_at,
 min(ts) AS period_start, max(ts) AS period_end, {_CATS} FROM ({T.EVENTS_SQL}) WHERE category IN {_IN} GROUP BY session_id"""


def _payloads(spark, sf):
    e = T.audit_events(spark, sf)
    repo = F.concat(F.lit("repo-"), (F.col("session_id").cast("long") % 7).cast("string"))
    day = F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("session_id").cast("long") % 28).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    return sync.build_payloads(e, repo, day)


@query(f"SELECT *, row_number() OVER (ORDER BY captured_at, session_label) AS place FROM ({_STORED})")
def store_scan(spark, sf):
    """Payloads built, validated, stored as rows and read back in order of their time."""
    folder = _folder(spark, "store")
    logs.ingest_payloads(_payloads(spark, sf), f"{folder}/rows", f"{folder}/quarantine")
    rows = logs.read_store(spark, f"{folder}/rows").select("repo_label", "session_label", "captured_at", "period_start", "period_end", *[F.col(f"payload.totals.{c}").alias(c) for c in P.CATEGORIES])
    return numbering.numbered(rows, "captured_at", "session_label", column="place")


@query(f"SELECT 'session_' || sha256(session_id)[1:16] AS session_label, category, value_hash, ts FROM ({T.EVENTS_SQL}) WHERE category IN {_IN}")
def payload_hashes(spark, sf):
    """The hashes that payloads carry: every known event once."""
    p = _payloads(spark, sf).select(F.from_json("payload_json", sync.PAYLOAD).alias("p"))
    return p.select(F.col("p.sessionLabel").alias("session_label"), F.explode("p.hashes").alias("h")).select("session_label", "h.category", F.col("h.valueHash").alias("value_hash"), F.col("h.timestamp").alias("ts"))


_HEAD = "<!doctype html><html lang=''en''><head><meta charset=''utf-8''><title>Team &lt;report&gt;</title></head><body><h1>Team &lt;report&gt;</h1>"
_CELLS = " || ".join(f"'<div><strong>' || {c} || '</strong><span>{c}</span></div>'" for c in P.CATEGORIES)
_ROW = " || ".join(f"'<td>' || {c} || '</td>'" for c in P.CATEGORIES)


@query(f"""WITH s AS (SELECT {_CATS}, count(DISTINCT session_id) FILTER (category IN {_IN}) AS sessions, min(ts)[1:10] AS a, max(ts)[1:10] AS b FROM ({T.EVENTS_SQL})),
d AS (SELECT string_agg('<tr><td>' || day || '</td>' || {_ROW} || '</tr>', '' ORDER BY day) AS rows FROM (SELECT ts[1:10] AS day, {_CATS} FROM ({T.EVENTS_SQL}) WHERE category IN {_IN} GROUP BY 1))
SELECT '{_HEAD}<p>' || sessions || ' sessions, ' || a || ' to ' || b || '</p><div>' || {_CELLS} || '</div><table><thead><tr><th>Date</th>{"".join(f"<th>{c.capitalize()}</th>" for c in P.CATEGORIES)}</tr></thead><tbody>' || rows || '</tbody></table></body></html>' AS page FROM s, d""")
def audit_report(spark, sf):
    """The report as a page, its days in order."""
    e = T.audit_events(spark, sf)
    return spark.createDataFrame([(audit.render_report(audit.summarize(e), audit.timeline(e), "Team <report>"),)], "page string")


@query("""SELECT unnest(['fixture-0', 'fixture-1', 'fixture-2']) AS path, unnest(['tuning', 'tuning', 'held-out']) AS split""")
def fixture_manifest(spark, sf):
    """A manifest written, read and unfolded."""
    path = _folder(spark, "manifest")
    spark.createDataFrame([(["fixture-0", "fixture-1"], ["fixture-2"])], "tuning array<string>, heldOut array<string>").write.json(path)
    return evaluate.fixtures(logs.read_manifest(spark, path))


@query("SELECT 'fixture-' || doc_id % 8 AS fixture, count(*) AS runs FROM labels GROUP BY 1")
def trial_artifacts(spark, sf):
    """Trials written to a folder for each fixture and read again."""
    path = _folder(spark, "trials")
    logs.write_trials(T.trials(spark, sf).withColumnRenamed("fixture_path", "fixture"), path)
    return spark.read.schema("status string, suspicious boolean, fixture string").json(path).groupBy("fixture").agg(F.count(F.lit(1)).alias("runs"))


@query("SELECT user_id, sha256('maskwright-session' || chr(0) || 'token-' || user_id) AS digest, user_id % 3 = 0 AS is_authorized FROM (SELECT DISTINCT user_id FROM events)")
def session_digests(spark, sf):
    """Digests of tokens in a domain of their own, and which tokens are the expected one."""
    u = T.table(spark, sf, "events", "user_id").distinct()
    token = F.concat(F.lit("token-"), F.col("user_id").cast("string"))
    supplied = F.when(F.col("user_id") % 3 == 0, "the token").when(F.col("user_id") % 3 == 1, "the toke")
    return u.select("user_id", keys.session_digest(token).alias("digest"), keys.same_token(supplied, "the token").alias("is_authorized"))


@query("""SELECT event_id, strftime(ts, '%b ') || day(ts) AS day_label, strftime(ts, '%b ') || day(ts) || ', ' || CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || strftime(ts, ':%M %p') || ' UTC' AS time_label, event_id % 3 || ' session' || CASE WHEN event_id % 3 = 1 THEN '' ELSE 's' END AS sessions,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events""")
def labels(spark, sf):
    """Labels of days, times and counts."""
    e = T.table(spark, sf, "events", "event_id", "ts")
    ts = F.col("ts")
    return e.select("event_id", X.day_label(ts).alias("day_label"), X.time_label(ts).alias("time_label"), X.plural(F.col("event_id") % 3, "session").alias("sessions"), X.iso(ts).alias("iso"))


@query(f"SELECT format('identifiers {{}}, comments {{}}, strings {{}}, secrets {{}}', identifier, comment, string, secret) AS line FROM (SELECT {_CATS} FROM ({T.EVENTS_SQL}))")
def live_tally(spark, sf):
    """The one line of running totals."""
    return T.audit_events(spark, sf).agg(*audit.category_counts()).select(S.tally_line().alias("line"))


# ---- mappings and paths


@query("SELECT o_orderkey, coalesce(c_name, '' || k) AS name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON c_custkey = k")
def mapping_lookup(spark, sf):
    """Every customer's name is known; a fourth of the orders asks for a key that isn't there."""
    o = T.table(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.withColumn("key", F.when(F.col("o_orderkey") % 4 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).cast("string"))
    m = T.table(spark, sf, "customer", "c_custkey", "c_name").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    return mapping.lookup(o, m, "key", "c_custkey", "c_name", "name").select("o_orderkey", "name")


_HELD = "(SELECT p_partkey, p_name || ' ' || p_partkey AS original, 's' || p_partkey AS synthetic FROM part)"


@query(f"""WITH m AS {_HELD}, w AS (SELECT CASE WHEN p_partkey % 4 = 3 THEN '#' || p_partkey ELSE original END AS original, CASE p_partkey % 4 WHEN 0 THEN synthetic WHEN 1 THEN synthetic || 'x' WHEN 2 THEN synthetic ELSE CASE WHEN p_partkey % 8 = 3 THEN synthetic ELSE 'n' || p_partkey END END AS synthetic FROM m)
SELECT original, synthetic, NOT (synthetic LIKE 's%x' OR (original LIKE '#%' AND synthetic LIKE 's%')) AS accepted FROM w""")
def mapping_register_exact(spark, sf):
    """Wanted pairs of whole part names against a mapping of all parts: known ones, others and new ones."""
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p = T.table(spark, sf, "part", "p_partkey", "p_name")
    held = p.select("p_partkey", F.concat_ws(" ", "p_name", s).alias("original"), F.concat(F.lit("s"), s).alias("synthetic"))
    original = F.when(k % 4 == 3, F.concat(F.lit("#"), s)).otherwise(F.col("original"))
    synthetic = F.when(k % 4 == 1, F.concat("synthetic", F.lit("x"))).when((k % 4 == 3) & (k % 8 != 3), F.concat(F.lit("n"), s)).otherwise(F.col("synthetic"))
    return mapping.register_exact(held.select("original", "synthetic"), held.select(original.alias("original"), synthetic.alias("synthetic")))


_PATHED = "(SELECT o_orderkey, 'See src/a' || o_custkey || '/main.ts, ./lib/b' || o_custkey || '.tsx and docs/c' || o_custkey || '/ or https://x.org/y.ts today' AS text FROM orders)"


def _pathed(spark, sf):
    c = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("See src/a"), c, F.lit("/main.ts, ./lib/b"), c, F.lit(".tsx and docs/c"), c, F.lit("/ or https://x.org/y.ts today"))
    return T.table(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", "o_custkey", text.alias("text"))


@query("""SELECT o_orderkey, unnest(['src/a' || o_custkey || '/main.ts', './lib/b' || o_custkey || '.tsx', '/x.org/y.ts', 'docs/c' || o_custkey || '/']) AS path FROM orders""")
def paths_found(spark, sf):
    """Path-shaped tokens of texts: files and folders, and what follows a URL's scheme but not the URL."""
    return _pathed(spark, sf).select("o_orderkey", F.explode(mapping.discovered_paths(F.col("text"))).alias("path"))


@query(f"SELECT o_orderkey, 'See source.ts, ./lib/b' || o_custkey || '.tsx and workspace or https://x.org/y.ts today' AS sent, text AS restored FROM orders JOIN {_PATHED} USING (o_orderkey)")
def paths_restored(spark, sf):
    """Paths out as aliases and back again, longest first."""
    c = F.col("o_custkey").cast("string")
    pairs = F.array(
        F.struct(F.concat(F.lit("docs/c"), c, F.lit("/")).alias("path"), F.lit("workspace").alias("alias")),
        F.struct(F.concat(F.lit("src/a"), c, F.lit("/main.ts")).alias("path"), F.lit("source.ts").alias("alias")),
    )
    out = _pathed(spark, sf).withColumn("pairs", pairs).withColumn("sent", mapping.alias_paths(F.col("text"), F.col("pairs")))
    return out.select("o_orderkey", "sent", mapping.restore_paths(F.col("sent"), F.col("pairs")).alias("restored"))


@query("""SELECT conv_id::VARCHAR AS session, '{' || string_agg('"s' || lpad(turn::VARCHAR, 4, '0') || '":"' || role || '"', ',' ORDER BY turn) || '}' AS mapping FROM conversations GROUP BY 1""")
def mappings_shown(spark, sf):
    """All of a session's mappings as one map, for inspection."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "role")
    names = c.select(F.col("conv_id").cast("string").alias("session"), F.concat(F.lit("s"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("synthetic"), F.col("role").alias("name"))
    return mapping.as_map(names, "session").select("session", F.to_json("mapping").alias("mapping"))


@query("SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) AS number FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)")
def conversation_reset(spark, sf):
    """Numbers begin anew with each conversation: the conversation is the session."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "role").withColumn("kind", F.lit("variable"))
    return mapping.first_seen(c, "conv_id", "kind", "role", "turn").select("conv_id", "role", "number")


# ---- restoration

_WORDS = {"the": "Maria", "de": "Jean", "and": "Company_1"}


def _whole(text: str) -> str:
    """Whole words replaced in SQL; twice, as neighbours share the character between them."""
    for _ in range(2):
        for a, b in _WORDS.items():
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9_$]){a}($|[^A-Za-z0-9_$])', '\\1{b}\\2', 'g')"
    return text


@query(f"SELECT conv_id, turn, {_whole('text')} AS text, turn AS number FROM conversations")
def json_restored(spark, sf):
    """Restoration in every string of a JSON value; keys, numbers and shape stay."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "text")
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("the"), F.col("turn").alias("de"))).alias("and")))
    back = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    out = c.select("conv_id", "turn", F.from_json(rehydrate.restore_json(body, back), "and array<struct<the:string,de:bigint>>").alias("v"))
    return out.select("conv_id", "turn", F.col("v.and")[0]["the"].alias("text"), F.col("v.and")[0]["de"].alias("number"))


@query(f"SELECT conv_id::VARCHAR AS conv_id, {_whole('t')} AS text FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1)")
def sse_restored_text(spark, sf):
    """The text of all restored frames of a stream, whatever its cuts."""
    return _restored_text(spark, sf, False)


@query(f"SELECT conv_id::VARCHAR AS conv_id, {_whole('t')} AS text FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1)")
def sse_buffered_text(spark, sf):
    """The same with whole blocks held back."""
    return _restored_text(spark, sf, True)


def _restored_text(spark, sf, buffered):
    from .queries import _frames

    out = S.restore_frames(_frames(spark, sf), "conv_id", "turn", "frame", _WORDS, buffer_text=buffered)
    delta = F.get_json_object(F.regexp_extract("frame", r"data: (.*)", 1), "$.delta.text")
    listed = out.select("conv_id", "seq", delta.alias("d")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "d"))).alias("ds"))
    return listed.select("conv_id", F.array_join("ds.d", "").alias("text"))


@query("SELECT page_id::VARCHAR AS page_id, (i - 1)::INTEGER AS seq, p AS frame FROM (SELECT page_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, list_filter(string_split(replace(html, '</p>', chr(10) || chr(10)), chr(10) || chr(10)), lambda x: x <> '') AS ps FROM pages))")
def chunked_frames(spark, sf):
    """Frames out of chunks of 37 bytes, which cut characters and frames."""
    p = T.table(spark, sf, "pages", "page_id", "html").withColumn("raw", F.replace("html", F.lit("</p>"), F.lit("\n\n")).cast("binary"))
    size = F.octet_length("raw")
    rows = p.select("page_id", "raw", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / 37) - 1, F.lit(0)).cast("int"))).alias("n"))
    chunks = rows.select("page_id", "n", F.substring("raw", F.col("n") * 37 + 1, F.lit(37)).alias("chunk"))
    return S.decode_chunks(chunks, "page_id", "n", "chunk")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, ts FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600000000")
def debounced_changes(spark, sf):
    """The last change of each burst, here of an hour."""
    e = T.table(spark, sf, "events", "user_id", "event_id", "ts")
    return S.debounced(e, "user_id", "ts", "event_id", 3_600_000).select("user_id", "event_id")


_NOTED = "(SELECT p_partkey, 'Look: ' || CASE p_partkey % 4 WHEN 0 THEN '// the ' || p_name WHEN 1 THEN '/* the ' || chr(10) || p_name || ' */ x' WHEN 2 THEN 'http' ELSE '/* a */ b // c' END AS text FROM part)"


def _noted(spark, sf):
    p, k = T.table(spark, sf, "part", "p_partkey", "p_name"), F.col("p_partkey") % 4
    note = F.when(k == 0, F.concat(F.lit("// the "), "p_name")).when(k == 1, F.concat(F.lit("/* the \n"), "p_name", F.lit(" */ x"))).when(k == 2, "http").otherwise("/* a */ b // c")
    return p.select("p_partkey", "p_name", F.concat(F.lit("Look: "), note).alias("text"))


@query(f"SELECT p_partkey, unnest(regexp_extract_all(text, '(?s)//[^\\n]*|/\\*.*?\\*/')) AS comment FROM {_NOTED}")
def comments_found(spark, sf):
    return _noted(spark, sf).select("p_partkey", F.explode(rehydrate.find_comments(F.col("text"))).alias("comment"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '// keeps ' || p_name WHEN 1 THEN '/* ' || p_name || ' */' ELSE '// was ' || p_partkey END AS comment, p_partkey % 6 < 2 AS accepted FROM part""")
def comments_rewritten(spark, sf):
    """Answers of a model: fenced, plain, no comment, two lines, still with a synthetic name, none."""
    p, k, n = T.table(spark, sf, "part", "p_partkey", "p_name"), F.col("p_partkey") % 6, F.col("p_name")
    answer = (
        F.when(k == 0, F.concat(F.lit(" ```ts\n// keeps "), n, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit("/* "), n, F.lit(" */"))).when(k == 2, n)
        .when(k == 3, F.concat(F.lit("// "), n, F.lit("\nmore"))).when(k == 4, F.concat(F.lit("// the shelfVariable of "), n))
    )
    rows = p.select("p_partkey", F.concat(F.lit("// was "), F.col("p_partkey").cast("string")).alias("original"), F.array(F.lit("shelfVariable")).alias("synthetics"), answer.alias("answer"))
    return rehydrate.rewrite_comments(rows, "original", "synthetics", lambda _: F.col("answer")).select("p_partkey", "comment", "accepted")


_PLAN_WORDS = "(SELECT n_nationkey AS plan_seq, unnest([lower(n_name), 'the', 'w' || n_regionkey]) AS word, unnest([4, 1, 2]) AS points FROM nation)"
_COMMENT_WORDS = "(SELECT DISTINCT s_suppkey AS comment_id, unnest(CASE WHEN s_suppkey % 5 = 0 THEN ['none'] ELSE [lower(n_name), 'the', 'w' || (s_suppkey % 7)] END) AS word FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""WITH s AS (SELECT comment_id, plan_seq, sum(points) AS score FROM {_COMMENT_WORDS} JOIN {_PLAN_WORDS} USING (word) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY score DESC, plan_seq DESC) AS r FROM s)
SELECT s_suppkey AS comment_id, plan_seq, score::BIGINT AS score FROM supplier LEFT JOIN (SELECT * FROM b WHERE r = 1) ON comment_id = s_suppkey""")
def comment_plans(spark, sf):
    """The plan each comment belongs to: the best score, the later of equals, or none."""
    n = T.table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    plans = n.select(
        F.col("n_nationkey").alias("plan_seq"), F.array(F.lower("n_name")).alias("synthetics"), F.array(F.concat(F.lit("w"), F.col("n_regionkey").cast("string"))).alias("glossary"), F.array(F.lit("the")).alias("vocabulary")
    )
    s = T.table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    words = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lower("n_name"), F.lit("the"), F.concat(F.lit("w"), (F.col("s_suppkey") % 7).cast("string"))))
    return rehydrate.comment_scores(s.select(F.col("s_suppkey").alias("comment_id"), words.alias("words")), plans)


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(['and', 'de', 'la', 'the', 'und'], lambda x: list_contains(ws, x) AND x <> CASE doc_id % 2 WHEN 0 THEN 'the' ELSE 'de' END)), ',') AS unresolved
FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS ws FROM documents)""")
def glossary_gaps(spark, sf):
    """Domain words of a text that its glossary has no original for."""
    d = T.table(spark, sf, "documents", "doc_id", "text")
    known = F.create_map(F.when(F.col("doc_id") % 2 == 0, "the").otherwise("de"), F.lit("Row"))
    words = F.array(*[F.lit(x) for x in ("the", "de", "la", "and", "und")])
    return d.select("doc_id", F.array_join(rehydrate.unresolved_terms(F.col("text"), words, known), ",").alias("unresolved"))


_MIXED = f"(SELECT s_suppkey, text || ' Write to Anna.Berg@Nova.org or Nova Labs, 212-555-0102.' AS text FROM {_LETTER_SQL})"


@query(f"""WITH r AS ({" UNION ALL ".join(f"SELECT s_suppkey, start_at, value, '{t}' AS type FROM ({_spans_sql(P.ENTITY_PATTERNS[t], _MIXED, 's_suppkey')})" for t in P.ENTITY_PATTERNS)}),
n AS ({_names_sql(_MIXED, 's_suppkey')})
SELECT * FROM r UNION ALL SELECT s_suppkey, start_at, value, type FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.s_suppkey = n.s_suppkey AND n.start_at < r.start_at + length(r.value) AND n.start_at + length(n.value) > r.start_at)""")
def pii_all_spans(spark, sf):
    """Patterns and names of one text together: a name that overlaps a pattern's match is no span."""
    n = T.table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("landia")).alias("p"))
    s = T.table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(n, "s_nationkey")
    third = F.when(F.col("s_suppkey") % 3 == 0, "Stripe").when(F.col("s_suppkey") % 3 == 1, "NASA").otherwise("Oslo")
    text = F.concat(F.lit("Dear Maria "), F.char(F.lit(65) + F.col("s_suppkey") % 26), F.lit("ovak, The "), "p", F.lit(" Holdings and "), third, F.lit(" met Jean-Luc O'Neil of Delta Group Inc near Rome on Monday. Write to Anna.Berg@Nova.org or Nova Labs, 212-555-0102."))
    rows = s.select("s_suppkey", F.inline(pii.all_spans(text)))
    return rows.select("s_suppkey", F.col("start").cast("long").alias("start_at"), "value", "type")


@query(r"SELECT p_partkey, regexp_replace(s, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM (SELECT p_partkey, p_name || '.' || p_type || ' (x|y)*[z]+{2}^$\ ?' AS s FROM part)")
def regex_escaped(spark, sf):
    p = T.table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", X.escape_regex(F.concat("p_name", F.lit("."), "p_type", F.lit(" (x|y)*[z]+{2}^$\\ ?"))).alias("escaped"))


# ---- evaluation


@query("""WITH f AS (SELECT DISTINCT 'fixture-' || doc_id % 8 AS path FROM labels),
m AS (SELECT path, 'tuning' AS split FROM f WHERE path < 'fixture-6' UNION ALL SELECT path, 'held-out' FROM f WHERE path IN ('fixture-5', 'fixture-6') UNION ALL SELECT 'fixture-x', 'tuning')
SELECT * FROM (SELECT coalesce(f.path, h.path) AS path, CASE WHEN f.path IS NULL THEN 'no such file' WHEN h.path IS NULL THEN 'in no split' WHEN h.n > 1 THEN 'in both splits' END AS error
FROM f FULL JOIN (SELECT path, count(DISTINCT split) AS n FROM m GROUP BY 1) h USING (path)) WHERE error IS NOT NULL""")
def split_errors(spark, sf):
    """Files that the two halves of a corpus share, miss or make up."""
    f = T.trials(spark, sf).select(F.col("fixture_path").alias("path")).distinct()
    members = f.filter("path < 'fixture-6'").withColumn("split", F.lit("tuning")).unionByName(f.filter("path IN ('fixture-5', 'fixture-6')").withColumn("split", F.lit("held-out")))
    made_up = spark.createDataFrame([("fixture-x", "tuning")], "path string, split string")
    return evaluate.split_errors(f, members.unionByName(made_up))


_VARIANTS = ("original", "pool", "coherent")


@query(f"""WITH c AS (SELECT 'fixture-' || doc_id % 8 AS fixture_path, ({_sql_list(_VARIANTS)})[(doc_id // 8 % 3 + 1)::INTEGER] AS variant, CASE WHEN doc_id % 5 < doc_id // 8 % 3 THEN 'looks like generated code' ELSE 'fine' END AS response FROM documents),
r AS (SELECT fixture_path, variant, count(*) AS runs, avg(CASE WHEN response = 'fine' THEN 0.0 ELSE 1.0 END) AS rate FROM c GROUP BY ALL)
SELECT r.*, r.rate - b.rate AS difference FROM r LEFT JOIN (SELECT fixture_path, rate FROM r WHERE variant = 'original') b USING (fixture_path)""")
def variants_compared(spark, sf):
    """Responses of each variant of a fixture: how many are suspicious, and how far that is from the original's."""
    d = T.table(spark, sf, "documents", "doc_id")
    third = F.floor(F.col("doc_id") / 8) % 3
    variant = F.get(F.array(*[F.lit(v) for v in _VARIANTS]), third.cast("int"))
    response = F.when(F.col("doc_id") % 5 < third, "looks like generated code").otherwise("fine")
    return evaluate.compare_variants(d.select(F.concat(F.lit("fixture-"), (F.col("doc_id") % 8).cast("string")).alias("fixture_path"), variant.alias("variant"), response.alias("response")))


@query(f"""WITH f AS (SELECT DISTINCT 'fixture-' || doc_id % 8 AS fixture_path FROM labels)
SELECT fixture_path, variant, run::INTEGER AS run, CASE WHEN fixture_path = 'fixture-7' THEN NULL ELSE 12.0 / (4 * run * 2) END AS budget FROM f, (SELECT unnest({_sql_list(_VARIANTS)}) AS variant), (SELECT unnest([1, 2, 3]) AS run)""")
def variant_runs(spark, sf):
    """Each fixture with each variant and run, and what a call may cost."""
    f = T.trials(spark, sf).select("fixture_path").distinct()
    fixtures = F.when(F.col("fixture_path") == "fixture-7", 0).otherwise(4)
    return evaluate.variants(f, _VARIANTS, 3).withColumn("budget", evaluate.budget_per_call(F.lit(12.0), fixtures, F.col("run")))
