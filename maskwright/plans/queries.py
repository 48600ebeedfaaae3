"""Registered queries over the tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import audit, code, dashboard, evaluate, mapping, messages, numbering, pii, rehydrate, requests, sync
from ..streaming import frames as S
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _spans_sql(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Matches with offsets: lengths of the gaps and matches before each are summed."""
    return f"""SELECT {key}, i - 1 AS pos, (g + m)::BIGINT AS start_at, (g + m + length(v))::BIGINT AS end_at, v AS value FROM (
 SELECT {key}, i, ms[i] AS v, list_sum(list_transform(gs[1:i], lambda x: length(x))) AS g, coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS m
 FROM (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
 SELECT {key}, regexp_extract_all({text}, {_quoted(pattern)}) AS ms, string_split_regex({text}, {_quoted(pattern)}) AS gs FROM {source}) WHERE len(ms) > 0))"""


def _spans(df: DataFrame, key: str, spans) -> DataFrame:
    rows = df.select(key, F.posexplode(spans).alias("pos", "s"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.value").alias("value"))


# ---- entities


@query(_spans_sql(P.EMAIL))
def pii_email_spans(spark, sf):
    return _spans(T.table(spark, sf, "documents", "doc_id", "text"), "doc_id", X.find_spans(F.col("text"), P.EMAIL))


@query(_spans_sql(P.PHONE))
def pii_phone_spans(spark, sf):
    return _spans(T.table(spark, sf, "documents", "doc_id", "text"), "doc_id", X.find_spans(F.col("text"), P.PHONE))


_CARDS_SQL = "(SELECT c_custkey, 'Card of ' || c_name || ': ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '.' AS text FROM customer)"


def _cards(spark, sf):
    k = F.col("c_custkey")
    number = F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return T.table(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", F.concat(F.lit("Card of "), "c_name", F.lit(": "), number, F.lit(".")).alias("text"))


@query(_spans_sql(P.SSN, _CARDS_SQL, "c_custkey"))
def pii_ssn_spans(spark, sf):
    return _spans(_cards(spark, sf), "c_custkey", X.find_spans(F.col("text"), P.SSN))


@query(f"""WITH v AS (SELECT regexp_extract(text, {_quoted(P.SSN)}) AS real, min(c_custkey) AS k FROM {_CARDS_SQL} GROUP BY 1)
SELECT real, row_number() OVER (ORDER BY k, real) AS number, '000-00-' || CASE WHEN row_number() OVER (ORDER BY k, real) < 10000 THEN lpad((row_number() OVER (ORDER BY k, real))::VARCHAR, 4, '0') ELSE (row_number() OVER (ORDER BY k, real))::VARCHAR END AS token FROM v""")
def pii_ssn_tokens(spark, sf):
    cards = _cards(spark, sf).withColumn("spans", pii.regex_spans(F.col("text"), ("SSN",)))
    return pii.mint(pii.span_rows(cards, "c_custkey"), "c_custkey").select("real", "number", "token")


_COUNTS = " UNION ALL ".join(f"SELECT lang, '{t}' AS type, len(regexp_extract_all(text, {_quoted(p)})) AS n FROM documents" for t, p in P.ENTITY_PATTERNS.items())


@query(f"SELECT lang, type, sum(n)::BIGINT AS n_found, count(*) FILTER (n > 0) AS n_docs FROM ({_COUNTS}) GROUP BY ALL")
def pii_entity_counts(spark, sf):
    rows = T.table(spark, sf, "documents", "lang", "text").select("lang", F.inline(pii.entity_counts(F.col("text"))))
    return rows.groupBy("lang", "type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_found"), F.count_if(F.col("n") > 0).alias("n_docs"))


_FIRST_SQL = f"""WITH s AS ({_spans_sql(P.EMAIL)}), f AS (SELECT lower(trim(value)) AS k, min(struct_pack(a := doc_id, b := -start_at)) AS f FROM s GROUP BY 1),
m AS (SELECT k, 'redacted.contact' || row_number() OVER (ORDER BY f.a, f.b, k) || '@example.com' AS token FROM f)"""


@query(_FIRST_SQL + f"""
SELECT d.doc_id, CASE WHEN r.n IS NULL THEN d.text ELSE list_aggregate(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || coalesce(r.t[i], '')), 'string_agg', '') END AS sanitized_text, coalesce(r.n, 0) AS n_redactions
FROM (SELECT doc_id, text, string_split_regex(text, {_quoted(P.EMAIL)}) AS gs FROM documents) d
LEFT JOIN (SELECT doc_id, list(token ORDER BY pos) AS t, count(*) AS n FROM s JOIN m ON m.k = lower(trim(s.value)) GROUP BY 1) r USING (doc_id)""")
def pii_anonymize_email(spark, sf):
    out, _ = pii.anonymize(T.table(spark, sf, "documents", "doc_id", "text"), "doc_id", spans=pii.regex_spans(F.col("text"), ("EMAIL",)))
    return out.select("doc_id", "sanitized_text", "n_redactions")


@query("SELECT doc_id, true AS is_same FROM documents WHERE text IS NOT NULL")
def pii_roundtrip(spark, sf):
    docs = T.table(spark, sf, "documents", "doc_id", "text").filter("text IS NOT NULL")
    out, _ = pii.anonymize(docs, "doc_id")
    return out.select("doc_id", (pii.restore_exact(out) == F.col("text")).alias("is_same"))


_AMOUNT = "replace(format('{:,.2f}', o_totalprice), ' ', '')"


@query(f"""WITH a AS (SELECT o_orderkey, '$' || {_AMOUNT} AS amount, round(o_totalprice, 2) AS n FROM orders),
b AS (SELECT *, pow(10.0, floor(log10(n))) AS g, sin(n) * 10000 AS x FROM a),
c AS (SELECT *, floor(n * (0.85 + (x - floor(x)) * 0.3) / g + 0.5) * g AS r FROM b)
SELECT o_orderkey, amount, '$' || format('{{:,.2f}}', CASE WHEN r = n THEN r + g ELSE r END) AS token FROM c""")
def pii_money_shift(spark, sf):
    o = T.table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", amount.alias("amount")).withColumn("token", X.shift_money(F.col("amount")))


def _names_sql(source: str, key: str) -> str:
    return f"""WITH s AS ({_spans_sql(P.CAPITALIZED, source, key)}),
w AS (SELECT *, string_split_regex(value, '\\s+') AS ws FROM s),
k AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ws)), lambda i: len(list_filter(ws[1:i], lambda x: NOT list_contains({_sql_list(P.STOPWORDS)}, x))) = 0)), 0) AS n FROM w),
p AS (SELECT {key}, start_at + coalesce(list_sum(list_transform(ws[1:n], lambda x: length(x) + 1)), 0) AS start_at, ws[n + 1:] AS ws FROM k),
q AS (SELECT {key}, start_at::BIGINT AS start_at, array_to_string(ws, ' ') AS value, ws FROM p)
SELECT {key}, start_at, value, CASE WHEN list_contains({_sql_list(P.ORG_SUFFIXES)}, regexp_replace(ws[-1], '\\.$', '')) OR (len(ws) = 1 AND list_contains({_sql_list(P.KNOWN_ORGS)}, ws[1])) THEN 'ORGANIZATION' ELSE 'PERSON' END AS type
FROM q WHERE NOT regexp_matches(value, '{P.ACRONYM}') AND (len(ws) > 1 OR list_contains({_sql_list(P.KNOWN_ORGS)}, ws[1]))"""


def _named(df, key):
    return df.select(key, F.inline(pii.name_spans(F.col("text")))).select(key, F.col("start").cast("long").alias("start_at"), "value", "type")


@query(_names_sql("documents", "doc_id"))
def pii_name_spans(spark, sf):
    return _named(T.table(spark, sf, "documents", "doc_id", "text"), "doc_id")


_LETTER_SQL = """(SELECT s_suppkey, 'Dear Maria ' || chr((65 + s_suppkey % 26)::INTEGER) || 'ovak, The ' || n.p || ' Holdings and ' || CASE s_suppkey % 3 WHEN 0 THEN 'Stripe' WHEN 1 THEN 'NASA' ELSE 'Oslo' END
 || ' met Jean-Luc O''Neil of Delta Group Inc near Rome on Monday.' AS text FROM supplier JOIN (SELECT n_nationkey, chr((65 + n_nationkey)::INTEGER) || 'landia' AS p FROM nation) n ON n_nationkey = s_nationkey)"""


@query(_names_sql(_LETTER_SQL, "s_suppkey"))
def pii_org_person(spark, sf):
    n = T.table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.char(F.lit(65) + F.col("n_nationkey")), F.lit("landia")).alias("p"))
    s = T.table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(n, "s_nationkey")
    third = F.when(F.col("s_suppkey") % 3 == 0, "Stripe").when(F.col("s_suppkey") % 3 == 1, "NASA").otherwise("Oslo")
    text = F.concat(F.lit("Dear Maria "), F.char(F.lit(65) + F.col("s_suppkey") % 26), F.lit("ovak, The "), "p", F.lit(" Holdings and "), third, F.lit(" met Jean-Luc O'Neil of Delta Group Inc near Rome on Monday."))
    return _named(s.select("s_suppkey", text.alias("text")), "s_suppkey")


@query()
def pii_anonymize(spark, sf):
    """All types over all documents: patterns and names, minted and replaced."""
    out, _ = pii.anonymize(T.table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return out.select("doc_id", "sanitized_text", "n_redactions")


@query(f"""WITH RECURSIVE s AS (SELECT l_orderkey, (l_linenumber * 5 + l_partkey % 11)::BIGINT AS a, (l_linenumber * 5 + l_partkey % 11 + l_quantity)::BIGINT AS b FROM lineitem),
u AS (SELECT DISTINCT * FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b DESC) AS r FROM u),
w AS (SELECT l_orderkey, a, b, r, b AS last, true AS ok FROM n WHERE r = 1
 UNION ALL SELECT n.l_orderkey, n.a, n.b, n.r, CASE WHEN n.a >= w.last THEN n.b ELSE w.last END, n.a >= w.last FROM w JOIN n ON n.l_orderkey = w.l_orderkey AND n.r = w.r + 1)
SELECT l_orderkey, a AS start_at, b AS end_at FROM w WHERE ok""")
def span_overlap_resolve(spark, sf):
    li = T.table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    a = (F.col("l_linenumber") * 5 + F.col("l_partkey") % 11).cast("long")
    spans = li.select("l_orderkey", F.struct(a.cast("int").alias("start"), (a + F.col("l_quantity").cast("long")).cast("int").alias("end")).alias("s"))
    folded = spans.groupBy("l_orderkey").agg(F.collect_set("s").alias("ss"))  # the lines of one order
    rows = folded.select("l_orderkey", F.inline(X.resolve_overlaps(F.col("ss"))))
    return rows.select("l_orderkey", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


# ---- mappings

_BASE36 = "(CASE WHEN {n} < 36 THEN '' WHEN {n} < 1296 THEN d[({n} // 36 + 1)::INTEGER] ELSE d[({n} // 1296 + 1)::INTEGER] || d[({n} // 36 % 36 + 1)::INTEGER] END || d[({n} % 36 + 1)::INTEGER])"
_KINDS_SQL = "CASE event_type WHEN 'click' THEN 'function' WHEN 'view' THEN 'variable' WHEN 'purchase' THEN 'class' WHEN 'signup' THEN 'type' ELSE 'property' END"


@query(f"""WITH e AS (SELECT user_id % 50 AS session, {_KINDS_SQL} AS kind, 'n' || json_extract_string(props, '$.k') AS name, event_id FROM events),
f AS (SELECT session, kind, name, min(event_id) AS first_pos, max(event_id) AS last_pos FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY first_pos, name) AS n, '0123456789abcdefghijklmnopqrstuvwxyz' AS d FROM f)
SELECT session, kind, name, n AS number, CASE kind WHEN 'function' THEN 'func' WHEN 'variable' THEN 'var' WHEN 'property' THEN 'prop' ELSE kind END || '_' || {_BASE36.format(n='n')} AS synthetic FROM r""")
def mapping_numbering(spark, sf):
    e = T.table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "function", "view": "variable", "purchase": "class", "signup": "type", "error": "property"}.items() for x in kv]), F.col("event_type"))
    names = e.select((F.col("user_id") % 50).alias("session"), kind.alias("kind"), F.concat(F.lit("n"), F.get_json_object("props", "$.k")).alias("name"), "event_id")
    return mapping.allocate(names, "session", "kind", "name", "event_id").select("session", "kind", "name", "number", "synthetic")


@query("SELECT event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def mapping_reverse(spark, sf):
    return mapping.invert(T.table(spark, sf, "events", "event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")


@query("""WITH u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), z AS (SELECT max(ts) AS now FROM events)
SELECT user_id, epoch_us(now) // 1000 - epoch_us(last) // 1000 AS idle_ms, epoch_us(now) // 1000 - epoch_us(last) // 1000 >= 1800000 AS is_expired FROM u, z""")
def mapping_ttl(spark, sf):
    e = T.table(spark, sf, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    used = e.groupBy("user_id").agg(F.max("ts").alias("last_used")).crossJoin(F.broadcast(now))
    return mapping.expired(used, "last_used", F.col("now"), 1_800_000).select("user_id", "idle_ms", "is_expired")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def mapping_capacity(spark, sf):
    return mapping.within_capacity(T.table(spark, sf, "events", "user_id", "event_id", "ts"), "user_id", "ts", "event_id", 20).select("user_id", "event_id")


@query("""WITH f AS (SELECT p_brand AS session, CASE WHEN p_size % 4 = 0 THEN 'lib/' || p_type ELSE 'lib/' || p_type || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.tsx' END END AS path, p_size % 4 = 0 AS is_dir, p_partkey FROM part),
g AS (SELECT session, path, is_dir, min(p_partkey) AS first_pos FROM f GROUP BY ALL),
h AS (SELECT *, CASE WHEN is_dir THEN 'workspace' ELSE 'source' END AS stem, CASE WHEN is_dir THEN '' ELSE regexp_extract(path, '\\.[A-Za-z0-9]+$') END AS ext FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY session, stem, ext ORDER BY first_pos, path) AS n FROM h)
SELECT session, path, stem || CASE WHEN n = 1 THEN '' ELSE '_' || n END || ext AS alias FROM r""")
def path_aliases(spark, sf):
    p = T.table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    is_dir = F.col("p_size") % 4 == 0
    base = F.concat(F.lit("lib/"), "p_type")
    path = F.when(is_dir, base).otherwise(F.concat(base, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, ".ts").otherwise(".tsx")))
    rows = p.select(F.col("p_brand").alias("session"), path.alias("path"), is_dir.alias("is_dir"), "p_partkey")
    return mapping.path_aliases(rows, "session", "path", "p_partkey", "is_dir").select("session", "path", "alias")


_KNOWN = ("the", "that", "and", "with")


@query("SELECT doc_id, " + "".join("regexp_replace(" for _ in _KNOWN) + "text" + "".join(f", '\\b{w}\\b', 'var_{i + 1}', 'g')" for i, w in enumerate(_KNOWN)) + " AS text FROM documents")
def known_names_replace(spark, sf):
    names = {w: f"var_{i + 1}" for i, w in enumerate(_KNOWN)}
    return T.table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.replace_words(F.col("text"), names).alias("text"))


# ---- audit, payloads, dashboard


@query(T.EVENTS_SQL)
def audit_event_rows(spark, sf):
    return T.audit_events(spark, sf)


_CATS = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in P.CATEGORIES)
_IN = "('identifier', 'comment', 'string', 'secret')"


@query(f"SELECT {_CATS}, count(DISTINCT session_id) FILTER (category IN {_IN}) AS sessions, coalesce(min(ts)[1:10], 'no data') AS start_day, coalesce(max(ts)[1:10], 'no data') AS end_day FROM ({T.EVENTS_SQL})")
def audit_totals(spark, sf):
    return audit.summarize(T.audit_events(spark, sf)).withColumnsRenamed({"start": "start_day", "end": "end_day"})


@query(f"SELECT ts[1:10] AS day, {_CATS} FROM ({T.EVENTS_SQL}) WHERE category IN {_IN} GROUP BY 1")
def audit_timeline(spark, sf):
    return audit.timeline(T.audit_events(spark, sf))


@query(f"""SELECT format('{{}} identifiers, {{}} comments, {{}} strings, {{}} secrets across {{}} sessions ({{}} to {{}})', identifier, comment, string, secret, sessions, a, b) AS line FROM (
SELECT {_CATS}, count(DISTINCT session_id) FILTER (category IN {_IN}) AS sessions, min(ts)[1:10] AS a, max(ts)[1:10] AS b FROM ({T.EVENTS_SQL}))""")
def audit_stats_text(spark, sf):
    return audit.stats_text(audit.summarize(T.audit_events(spark, sf)))


@query(T.EVENTS_SQL)
def audit_log_roundtrip(spark, sf):
    """Events sealed and opened again."""
    key = F.lit(bytes(range(32)))
    return audit.decrypted(audit.encrypted(T.audit_events(spark, sf), key), key, "category string, value_hash string, ts string, session_id string")


@query(f"""SELECT 'repo_' || sha256('repo-' || (session_id::BIGINT % 7))[1:16] AS repo_label, 'session_' || sha256(session_id)[1:16] AS session_label, min(ts) AS period_start, max(ts) AS period_end, {_CATS}
FROM ({T.EVENTS_SQL}) WHERE category IN {_IN} GROUP BY session_id""")
def sync_payload_by_session(spark, sf):
    return sync.payload_parts(T.audit_events(spark, sf), F.concat(F.lit("repo-"), (F.col("session_id").cast("long") % 7).cast("string")))


_SPOILT = ("shape", "identity", "timestamps", "period", "totals", "total", "hashes", "hash contents")


@query("SELECT user_id, " + "CASE user_id % 9 " + " ".join(f"WHEN {i + 1} THEN '{e}'" for i, e in enumerate(_SPOILT)) + " END AS error FROM (SELECT DISTINCT user_id FROM events)")
def sync_validate(spark, sf):
    """Payloads of which some are spoilt in one way each."""
    u = T.table(spark, sf, "events", "user_id").distinct()
    k, h = F.col("user_id") % 9, F.sha2(F.col("user_id").cast("string"), 256)
    time = F.lit("2024-01-02T03:04:05.678Z")
    at = lambda i, bad, good: F.when(k == i, F.lit(bad)).otherwise(F.lit(good) if isinstance(good, str) else good)
    body = F.concat(
        F.lit('{"version":1,'), at(1, '"path":"/home",', ""), F.lit('"repoLabel":"repo_'), at(2, "home", F.substring(h, 1, 16)), F.lit('","sessionLabel":"session_'), F.substring(h, 1, 16),
        F.lit('","capturedAt":"'), at(3, "yesterday", time), F.lit('","period":{"start":"'), at(4, "2024-13-41T00:00:00Z", time), F.lit('","end":"'), time, F.lit('"},"totals":{"identifier":'),
        at(6, "-1", "3"), F.lit(',"comment":0,"string":1,"secret":2'), at(5, ',"path":1', ""), F.lit('},"hashes":'), at(7, '"none"', F.concat(F.lit('[{"category":"'), at(8, "name", "secret"), F.lit('","valueHash":"'), h, F.lit('","timestamp":"'), time, F.lit('"}]'))), F.lit("}"),
    )
    return sync.validated(u.select("user_id", body.alias("payload_json"))).select("user_id", "error")


_P = T.PAYLOADS_SQL
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in P.CATEGORIES)
_ALL = "(identifier + comment + string + secret)"


@query(f"SELECT {_SUMS}, count(DISTINCT session_label) AS sessions, count(DISTINCT repo_label) AS repos, coalesce(max(captured_at), 'Waiting for first sync') AS latest FROM ({_P})")
def dash_totals(spark, sf):
    return dashboard.totals(T.payload_rows(spark, sf))


@query(f"SELECT repo_label, count(DISTINCT session_label) AS sessions, sum({_ALL})::BIGINT AS total, min(captured_at) AS first_seen FROM ({_P}) GROUP BY 1")
def dash_by_repo(spark, sf):
    return dashboard.by_repo(T.payload_rows(spark, sf))


_DAYS = f"SELECT captured_at[1:10] AS day, {_SUMS}, sum({_ALL})::BIGINT AS total FROM ({_P}) GROUP BY 1"


@query(_DAYS)
def dash_by_day(spark, sf):
    return dashboard.by_day(T.payload_rows(spark, sf))


@query(f"{_DAYS} ORDER BY day DESC LIMIT 7")
def dash_top_days(spark, sf):
    return dashboard.top_days(dashboard.by_day(T.payload_rows(spark, sf)))


@query(f"""SELECT *, CASE WHEN sum(total) OVER () = 0 THEN 0 ELSE floor(100.0 * total / sum(total) OVER () + 0.5)::BIGINT END AS share FROM (
SELECT repo_label, count(DISTINCT session_label) AS sessions, sum({_ALL})::BIGINT AS total, min(captured_at) AS first_seen FROM ({_P}) GROUP BY 1)""")
def dash_repo_shares(spark, sf):
    return dashboard.repos_by_total(dashboard.by_repo(T.payload_rows(spark, sf)))


@query(f"""WITH t AS (SELECT unnest({_sql_list(P.CATEGORIES)}) AS category, unnest([sum(identifier), sum(comment), sum(string), sum(secret)]) AS total FROM ({_P}))
SELECT category, total::BIGINT AS total, CASE WHEN sum(total) OVER () = 0 THEN 0 ELSE floor(100.0 * total / sum(total) OVER () + 0.5)::BIGINT END AS share FROM t""")
def dash_category_shares(spark, sf):
    return dashboard.category_shares(T.payload_rows(spark, sf))


@query(f"SELECT i::INTEGER AS i, greatest(max(total), 1)::BIGINT AS max_total, greatest(max(total), 1) * i / 4.0 AS tick FROM ({_DAYS}), range(0, 5) t(i) GROUP BY i")
def dash_chart_ticks(spark, sf):
    return dashboard.chart_ticks(dashboard.by_day(T.payload_rows(spark, sf)))


@query(f"SELECT repo_label, max(captured_at) AS captured_at, arg_max(session_label, captured_at) AS session_label FROM ({_P}) GROUP BY 1")
def latest_session(spark, sf):
    return dashboard.latest_by(T.payload_rows(spark, sf), "repo_label", "captured_at", "session_label")


# ---- messages


@query(f"""WITH t AS ({T.TURNS_SQL}), c AS (SELECT * FROM t WHERE role = 'assistant'),
s AS (SELECT conv_id, msg, unnest(CASE tool WHEN 'Edit' THEN [{{'route': 'code', 'field': 'old_string', 'value': text}}, {{'route': 'code', 'field': 'new_string', 'value': text || '!'}}]
 WHEN 'Write' THEN [{{'route': 'code', 'field': 'content', 'value': text}}] ELSE [{{'route': 'names', 'field': 'command', 'value': text}}] END, recursive := true) FROM c),
r AS (SELECT t.conv_id, t.msg, CASE WHEN c.tool = 'Bash' THEN 'names' ELSE 'code' END AS route, 'result' AS field, t.text AS value FROM t LEFT JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1 WHERE t.role = 'user')
SELECT conv_id, msg, route, field, length(value) AS n_chars FROM (SELECT * FROM s UNION ALL SELECT * FROM r) WHERE length(value) > 0""")
def msg_route(spark, sf):
    rows = messages.blocks(T.bodies(spark, sf), "conv_id")
    out = messages.routed(rows, "conv_id")
    return out.select("conv_id", F.col("msg").cast("long").alias("msg"), "route", "field", F.length("value").cast("long").alias("n_chars"))


@query(f"""WITH t AS ({T.TURNS_SQL}) SELECT t.conv_id, t.msg, c.tool, coalesce(CASE WHEN c.tool = 'Bash' THEN CASE WHEN c.text <> '' THEN 'Bash: ' || CASE WHEN length(c.text) > 60 THEN left(c.text, 60) || '…' ELSE c.text END ELSE 'Bash' END ELSE 'src/f' || c.conv_id || '.ts' END, 'tool_result') AS label
FROM t LEFT JOIN t c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1 AND c.role = 'assistant' WHERE t.role = 'user'""")
def msg_results(spark, sf):
    rows = messages.blocks(T.bodies(spark, sf), "conv_id")
    return messages.results(rows, "conv_id").select("conv_id", F.col("msg").cast("long").alias("msg"), "tool", "label")


@query(f"""WITH t AS ({T.TURNS_SQL}) SELECT conv_id, msg, 0::BIGINT AS block, role, CASE role WHEN 'system' THEN 'text' WHEN 'assistant' THEN 'tool_use' ELSE 'tool_result' END AS type FROM t""")
def msg_blocks(spark, sf):
    rows = messages.blocks(T.bodies(spark, sf), "conv_id")
    return rows.select("conv_id", F.col("msg").cast("long").alias("msg"), F.col("block").cast("long").alias("block"), "role", "type")


@query("SELECT conv_id::VARCHAR AS session, 0::BIGINT AS number, true AS is_json, count(*) FILTER (role <> 'system')::BIGINT AS n_blocks FROM conversations GROUP BY conv_id")
def request_transform(spark, sf):
    """Whole bodies transformed, one session each; their shape stays."""
    b = T.bodies(spark, sf).select(F.col("conv_id").cast("string").alias("session"), F.lit(0).cast("long").alias("number"), "body")
    out = requests.transform_bodies(b, "session", "number")
    kinds = F.regexp_count("output", F.lit('"type":"tool_(?:use|result)"'))
    return out.select("session", "number", F.try_parse_json("output").isNotNull().alias("is_json"), kinds.cast("long").alias("n_blocks"))


# ---- evaluation

_JUDGED_SQL = "(SELECT conv_id, turn, text || ' ' || CASE conv_id % 6 WHEN 0 THEN 'This looks auto-generated.' WHEN 1 THEN 'Weird naming and a placeholder.' WHEN 2 THEN 'Comments were STRIPPED comments here' WHEN 3 THEN 'A mixed vocabulary, inconsistently used' ELSE 'fine' END AS text FROM conversations)"


def _judged(spark, sf):
    k = F.col("conv_id") % 6
    note = F.when(k == 0, "This looks auto-generated.").when(k == 1, "Weird naming and a placeholder.").when(k == 2, "Comments were STRIPPED comments here").when(k == 3, "A mixed vocabulary, inconsistently used").otherwise("fine")
    return T.table(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.concat("text", F.lit(" "), note).alias("text"))


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS rule FROM {_JUDGED_SQL} WHERE regexp_matches(text, {_quoted('(?i)' + p)})" for n, p in P.SUSPICION_RULES))
def suspicion_signals(spark, sf):
    return _judged(spark, sf).select("conv_id", "turn", F.explode(evaluate.signals(F.col("text"))).alias("rule"))


@query("""SELECT conv_id, turn, CASE conv_id % 5 WHEN 4 THEN 'invalid json' WHEN 3 THEN 'schema' WHEN 2 THEN 'quote not null' WHEN 1 THEN CASE WHEN position('zzz' IN text) > 0 THEN NULL ELSE 'quote missing' END END AS error FROM conversations""")
def verdict_valid(spark, sf):
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "text")
    k = F.col("conv_id") % 5
    output = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.lit(True).alias("suspicious"), F.substring("text", 1, 3).alias("quote"), F.lit("r").alias("reason")).alias("structured_output"))))
        .when(k == 1, F.lit('{"suspicious":true,"quote":"zzz","reason":"r"}'))
        .when(k == 2, F.lit('{"result":"{\\"suspicious\\":false,\\"quote\\":\\"a\\",\\"reason\\":\\"r\\"}"}'))
        .when(k == 3, F.lit('{"suspicious":false,"reason":"r"}'))
        .otherwise("not json")
    )
    return evaluate.verdicts(c.withColumn("output", output), "output", "text").select("conv_id", "turn", "error")


@query("""WITH t AS (SELECT 'fixture-' || doc_id % 8 AS fixture_path, CASE WHEN doc_id % 9 = 0 OR doc_id % 8 = 7 THEN 'failed' ELSE 'completed' END AS status, toxic = 1 AS suspicious FROM labels),
a AS (SELECT fixture_path, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'completed' AND suspicious) AS n_suspicious, count(*) FILTER (status = 'failed') AS failed FROM t GROUP BY 1)
SELECT *, CASE WHEN completed = 0 THEN NULL ELSE n_suspicious / completed END AS suspicion_rate FROM a""")
def suspicion_rate(spark, sf):
    return evaluate.suspicion_rates(T.trials(spark, sf))


@query("""WITH f AS (SELECT DISTINCT 'fixture-' || doc_id % 8 AS path FROM labels), m AS (SELECT path, CASE WHEN path >= 'fixture-6' THEN 'held-out' ELSE 'tuning' END AS split FROM f WHERE path <> 'fixture-0'),
c AS (SELECT path, purpose, 1 + length(path) % 4 + (path[-1])::INTEGER % 3 AS trials FROM f, (VALUES ('tuning'), ('held-out')) v(purpose)),
j AS (SELECT c.*, CASE WHEN split IS NULL THEN 'unknown fixture' WHEN purpose = 'tuning' AND split <> 'tuning' THEN 'held out' WHEN purpose = 'tuning' AND trials < 3 THEN 'too few trials' WHEN purpose = 'held-out' AND trials <> 1 THEN 'exactly one trial' END AS error FROM c LEFT JOIN m USING (path))
SELECT path, purpose, error FROM j WHERE error IS NOT NULL""")
def fixture_membership(spark, sf):
    f = T.trials(spark, sf).select(F.col("fixture_path").alias("path")).distinct()
    members = f.filter("path <> 'fixture-0'").withColumn("split", F.when(F.col("path") >= "fixture-6", "held-out").otherwise("tuning"))
    trials = 1 + F.length("path") % 4 + F.substring("path", -1, 1).cast("int") % 3
    chosen = f.withColumn("purpose", F.explode(F.array(F.lit("tuning"), F.lit("held-out")))).withColumn("trials", trials)
    return evaluate.membership_errors(chosen, members).select("path", "purpose", "error")


_OWN, _EVERY, _MAPPED = ("the", "de", "der"), ("the", "de", "der", "que", "und", "and"), ("the", "la", "shelfVariable")


@query(f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS ws FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter({_sql_list(w for w in _EVERY if w not in _OWN)}, lambda x: list_contains(ws, x))), ',') AS foreign_terms,
 array_to_string(list_sort(list_filter({_sql_list(_MAPPED)}, lambda x: NOT list_contains(ws, x))), ',') AS missing FROM t""")
def vocab_terms(spark, sf):
    lists = [F.array(*[F.lit(x) for x in v]) for v in (_OWN, _EVERY, _MAPPED)]
    d = T.table(spark, sf, "documents", "doc_id", "text").withColumn("ws", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))))
    v = d.select("doc_id", evaluate.vocabulary(F.col("ws"), *lists).alias("v"))
    return v.select("doc_id", F.array_join("v.foreign", ",").alias("foreign_terms"), F.array_join("v.missing", ",").alias("missing"))


# ---- text functions

_HASH_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name || ' notes', ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (h * 31 + c) % 1000003)"


@query(f"""WITH f AS (SELECT c_custkey, c_name, {_HASH_SQL} AS h FROM customer)
SELECT c_custkey, h AS fingerprint, '// ' || ({_sql_list(P.PHRASES["stealth", "medium"])})[((list_reduce(list_prepend(0::BIGINT, list_transform(string_split('// ' || c_name || ' notes', ''), lambda x: unicode(x)::BIGINT)), lambda a, c: (a * 31 + c) % 1000003) + 2) % 5 + 1)::INTEGER] AS placeholder FROM f""")
def comment_placeholders(spark, sf):
    c = T.table(spark, sf, "customer", "c_custkey", "c_name").withColumn("note", F.concat("c_name", F.lit(" notes")))
    return c.select("c_custkey", X.fingerprint(F.col("note")).alias("fingerprint"), X.comment_placeholder(F.concat(F.lit("// "), "note"), F.lit(2), "stealth").alias("placeholder"))


@query(f"""SELECT p_partkey, length(s) >= 15 AND NOT regexp_matches(s, '{P.MACHINE_TOKEN}') AND len(list_filter(string_split_regex(s, '[ _]+'), lambda x: x <> '')) >= 2 AS is_redactable
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' of ' || p_brand WHEN 1 THEN replace(p_name, ' ', '_') || '_' || p_type ELSE p_name END AS s FROM part)""")
def redactable_strings(spark, sf):
    k = F.col("p_partkey") % 3
    s = F.when(k == 0, F.concat("p_name", F.lit(" of "), "p_brand")).when(k == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type")).otherwise(F.col("p_name"))
    return T.table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", X.redactable(s).alias("is_redactable"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, CASE WHEN len(string_split(text, chr(10))) < 2 OR doc_id % 2 = 1 THEN NULL ELSE true END AS is_same FROM documents""")
def line_numbers(spark, sf):
    """Lines numbered and stripped again; every other text skips a number, so it isn't stripped."""
    d = T.table(spark, sf, "documents", "doc_id", "text")
    step = F.when(F.col("doc_id") % 2 == 1, 2).otherwise(1)
    numbered = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lpad(((i + 1) * step).cast("string"), 6, " "), F.lit("\t"), x)), "\n")
    d = d.withColumn("numbered", numbered).withColumn("s", X.strip_line_numbers(F.col("numbered")))
    same = F.when(F.col("s").isNotNull(), (F.col("s.source") == F.col("text")) & (X.restore_line_numbers(F.col("s.source"), F.col("s.prefixes")) == F.col("numbered")))
    return d.select("doc_id", X.line_count(F.col("text")).cast("long").alias("n_lines"), same.alias("is_same"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
 CASE WHEN length(url) > 60 THEN left(url, 60) || '…' ELSE url END AS label, upper(url[1]) || url[2:] AS capital, regexp_extract(url, '\\.[A-Za-z0-9]+$') AS ext, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages""")
def text_functions(spark, sf):
    p, u = T.table(spark, sf, "pages", "page_id", "url", "html"), F.col("url")
    return p.select("page_id", X.escape_html(F.col("html")).alias("escaped"), X.truncate(u).alias("label"), X.capitalize(u).alias("capital"), X.extension(u).alias("ext"), X.dirname(u).alias("folder"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf):
    """Whole pages escaped."""
    return T.table(spark, sf, "pages", "page_id", "html").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|<[^>]*$|[^<]+'), lambda p: CASE WHEN p[1] = '<' THEN p ELSE replace(replace(p, 'the', 'Candidate_Alpha'), 'and', 'Company_1') END), '') AS html FROM pages""")
def html_text_rehydrate(spark, sf):
    """Tokens restored in text between tags, never inside one."""
    p = T.table(spark, sf, "pages", "page_id", "html")
    pairs = F.array(*[F.struct(F.lit(a).alias("token"), F.lit(b).alias("real")) for a, b in (("the", "Candidate_Alpha"), ("and", "Company_1"))])
    return p.select("page_id", pii.restore_html(F.col("html"), pairs).alias("html"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def global_numbers(spark, sf):
    return numbering.numbered(T.table(spark, sf, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "n")


# ---- code


@query()
def code_obfuscate(spark, sf):
    out = code.obfuscate_files(T.snippets(spark, sf), "session", "path", "source")
    return out.select("session", "path", "output", "changed", "comments", "strings", "constants")


@query("SELECT p_partkey, true AS is_same FROM part")
def code_roundtrip(spark, sf):
    """Files renamed and restored: the redacted text comes back with its own names."""
    s = T.snippets(spark, sf)
    out = code.obfuscate_files(s, "session", "path", "source")
    back = out.select("session", "path", "output", F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v")))).alias("back"))
    restored = back.select("session", "path", rehydrate.restore_column(F.col("output"), F.col("back")).alias("restored"))
    j = s.join(restored, ["session", "path"])
    body = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r'"[^"]*"', '""'), r"'\w+'", "''")
    return j.select("p_partkey", (body(F.col("restored")) == body(F.col("source"))).alias("is_same"))


@query("SELECT p_partkey, 1::BIGINT AS n_comments, 2::BIGINT AS n_constants_declared FROM part")
def code_tokens(spark, sf):
    t = code.tokens_of(T.snippets(spark, sf), "p_partkey", "source")
    return t.groupBy("p_partkey").agg(F.count_if(F.col("kind") == "comment").alias("n_comments"), (F.count_if(F.col("text") == "const") - 1).alias("n_constants_declared"))


@query()
def code_disguise(spark, sf):
    return code.disguise_files(T.snippets(spark, sf), "p_partkey", "source").select("p_partkey", "domain", "valid", "reason", "output")


# ---- frames


def _frames(spark, sf):
    """Frames of each conversation: a delta for each turn and a stop."""
    c = T.table(spark, sf, "conversations", "conv_id", "turn", "text")
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("text").alias("text")).alias("delta")))
    return c.select("conv_id", "turn", F.concat(F.lit("event: content_block_delta\ndata: "), delta).alias("frame"))


@query()
def sse_restore(spark, sf):
    return S.restore_frames(_frames(spark, sf), "conv_id", "turn", "frame", {"the": "Maria", "de": "Jean"})


@query("SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS bytes_so_far, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 2000 AS is_within FROM conversations")
def stream_byte_limit(spark, sf):
    return S.within_bytes(T.table(spark, sf, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "bytes_so_far", "is_within")


@query("SELECT page_id, (i - 1)::INTEGER AS seq, p AS frame FROM (SELECT page_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, string_split(replace(html, '</p>', chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM pages)) WHERE length(p) > 0")
def sse_frames(spark, sf):
    p = T.table(spark, sf, "pages", "page_id", "html").withColumn("body", F.replace("html", F.lit("</p>"), F.lit("\n\n")))
    return S.frames(p, "page_id", "body")


@query(f"SELECT date_trunc('day', ts::TIMESTAMP) AS day, {_CATS} FROM ({T.EVENTS_SQL}) GROUP BY 1")
def running_totals(spark, sf):
    """Batch twin of the streaming totals."""
    return S.running_totals(T.audit_events(spark, sf)).withColumn("day", F.col("day").cast("timestamp_ntz"))
