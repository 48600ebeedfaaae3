"""Golden cases and properties of the core operators."""

import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.functions import text as X
from maskwright.operators import audit, code, evaluate, mapping, messages, numbering, pii, rehydrate, sync
from maskwright.session import Settings
from maskwright.sources import keys, logs
from maskwright.streaming import frames as S


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,found",
    [
        ("mail a.b@c.org now", [("EMAIL", "a.b@c.org")]),
        ("call (212) 555-0101 or 212-555-0102", [("PHONE", "(212) 555-0101"), ("PHONE", "212-555-0102")]),
        ("id 123-45-6789", [("SSN", "123-45-6789")]),
        ("paid $1,250.00 and $7.25, not $12", [("MONEY", "$1,250.00"), ("MONEY", "$7.25")]),
        ("", []),
    ],
)
def test_entity_patterns(spark, text, found):
    spans = one(spark, text, pii.regex_spans(F.col("text")))
    assert [(s["type"], s["value"]) for s in spans] == found
    assert all(text[s["start"] : s["end"]] == s["value"] for s in spans)


def test_names(spark):
    spans = one(spark, "Dear Anna Berg, The Nova Holdings and Stripe met NASA in Oslo", pii.name_spans(F.col("text")))
    assert [(s["type"], s["value"]) for s in spans] == [("PERSON", "Anna Berg"), ("ORGANIZATION", "Nova Holdings"), ("ORGANIZATION", "Stripe")]


def test_anonymize_is_exact_and_repeatable(spark):
    rows = [(1, "Anna Berg wrote to a@x.org. Anna Berg paid $450,000."), (2, "a@X.org and b@x.org"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    out, table = pii.anonymize(df, "id")
    got = {r["id"]: r for r in out.collect()}
    assert got[3]["sanitized_text"] is None and got[4]["sanitized_text"] == "" and got[4]["n_redactions"] == 0
    assert got[1]["sanitized_text"].count("Candidate_Alpha") == 2 and "Anna" not in got[1]["sanitized_text"]
    # numbers run from right to left inside a text; both spellings of one address share a token
    assert got[2]["sanitized_text"] == "redacted.contact1@example.com and redacted.contact2@example.com"
    back = {r["id"]: r["t"] for r in out.select("id", pii.restore_exact(out).alias("t")).collect()}
    assert back == dict(rows)
    again, _ = pii.anonymize(out.select("id", F.col("sanitized_text").alias("text")), "id", mapping=table)
    assert {r["id"]: r["sanitized_text"] for r in again.collect()} == {k: r["sanitized_text"] for k, r in got.items()}


def test_numbers_of_mint_run_right_to_left(spark):
    out, _ = pii.anonymize(spark.createDataFrame([(1, "a@x.org b@x.org")], "id long, text string"), "id")
    assert out.first()["sanitized_text"] == "redacted.contact2@example.com redacted.contact1@example.com"


@pytest.mark.parametrize("n,token", [(1, "Candidate_Alpha"), (24, "Candidate_Omega"), (25, "Candidate_Alpha2")])
def test_person_tokens(spark, n, token):
    assert spark.range(1).select(pii.minted(F.lit("PERSON"), F.lit(n).cast("long"), F.lit("x")).alias("t")).first()["t"] == token


def test_phone_tokens_keep_long_numbers(spark):
    assert spark.range(1).select(pii.minted(F.lit("PHONE"), F.lit(100).cast("long"), F.lit("x")).alias("t")).first()["t"] == "555-01100"


def test_longest_token_first(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("token"), F.lit(b).alias("real")) for a, b in (("Company_1", "Uno"), ("Company_10", "Ten"))])
    assert one(spark, "Company_10, Company_1", pii.restore_tokens(F.col("text"), pairs)) == "Ten, Uno"


def test_overlaps(spark):
    df = spark.createDataFrame([([(0, 4), (0, 9), (8, 12), (9, 10)],)], "s array<struct<start:int,end:int>>")
    assert [(s["start"], s["end"]) for s in df.select(X.resolve_overlaps(F.col("s")).alias("r")).first()["r"]] == [(0, 9), (9, 10)]


def test_ascii_boundaries(spark):
    spans = one(spark, "éAb Cd xÉFg Hi", X.find_spans(F.col("text"), r"\b[A-Z][a-z]\b"))
    assert [s["value"] for s in spans] == ["Ab", "Cd", "Fg", "Hi"]


def test_money(spark):
    for text in ("$450,000", "$0.00", "$9.90"):
        token = one(spark, text, X.shift_money(F.col("text")))
        assert (token == text) == (text == "$0.00") and ("." in token) == ("." in text)


def test_line_numbers(spark):
    text = "     1\tx\n     2\ty"
    s = one(spark, text, X.strip_line_numbers(F.col("text")))
    assert s["source"] == "x\ny" and len(s["prefixes"]) == 2
    for bad in ("     1\tx", "     1\tx\n     3\ty", "x\ny", ""):
        assert one(spark, bad, X.strip_line_numbers(F.col("text"))) is None


def test_placeholder_keeps_lines(spark):
    for c in ("// short", "/* a\nb\nc */", "/* one line that is somewhat longer than others */"):
        got = one(spark, c, X.comment_placeholder(F.col("text"), F.lit(1), "compact"))
        assert got == code.placeholder(c, 1, "compact") and got.count("\n") == c.count("\n")


def test_numbering_is_gapless(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows = numbering.numbered(df, "k").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))
    assert numbering.numbered(df.limit(0), "k").count() == 0


def test_mapping_state(spark):
    names = spark.createDataFrame([("s", "function", "a", 2), ("s", "function", "b", 1), ("s", "function", "a", 0), ("s", "variable", "func_1", 3)], "session string, kind string, name string, pos long")
    got = {r["name"]: r["synthetic"] for r in mapping.allocate(names, "session", "kind", "name", "pos").collect()}
    assert got["b"] == "func_2" and got["a"] == "func_1_" and got["func_1"] == "var_1"
    pooled = [r["synthetic"] for r in mapping.allocate(names, "session", "kind", "name", "pos", style="stealth").collect()]
    assert len(set(pooled)) == 3


def test_audit_log(spark, tmp_path):
    key = F.lit(bytes(range(32)))
    events = spark.createDataFrame([("comment", "h", "2024-01-02T00:00:00.000Z", "s"), ("odd", "g", "2023-12-31T00:00:00.000Z", "t")], logs.EVENT)
    path = f"file://{tmp_path}/log"
    assert logs.read_audit(spark, path, key).count() == 0
    logs.append_audit(events, path, key)
    logs.append_audit(events, path, key)
    assert logs.read_audit(spark, path, key).count() == 4
    s = audit.summarize(events).first()
    assert (s["comment"], s["sessions"], s["start"], s["end"]) == (1, 1, "2023-12-31", "2024-01-02")
    assert audit.summarize(events.limit(0)).first()["start"] == "no data"
    with pytest.raises(Exception, match="(?i)decrypt|tag|aes"):
        logs.read_audit(spark, path, F.lit(bytes(32))).collect()
    broken = audit.encrypted(events, key).withColumn("version", F.lit(2))
    with pytest.raises(Exception, match="version"):
        audit.decrypted(broken, key, logs.EVENT).collect()
    assert "<td>1</td>" in audit.render_report(audit.summarize(events), audit.timeline(events))


def test_payloads_are_valid(spark):
    events = spark.createDataFrame([("comment", "a" * 64, "2024-01-02T00:00:00.000Z", "s"), ("secret", "b" * 64, "2024-01-03T00:00:00.000Z", "s")], logs.EVENT)
    made = sync.build_payloads(events, F.lit("repo"), F.lit("2024-01-04T00:00:00Z"))
    row = sync.validated(made).first()
    assert row["error"] is None
    body = json.loads(row["payload_json"])
    assert body["totals"] == {"identifier": 0, "comment": 1, "string": 0, "secret": 1} and len(body["hashes"]) == 2
    for change, error in (({"x": 1}, "shape"), ({"repoLabel": "home"}, "identity"), ({"capturedAt": 5}, "timestamps"), ({"totals": {"comment": -1}}, "total"), ({"hashes": [{"category": "comment"}]}, "hash contents")):
        spoilt = spark.createDataFrame([(json.dumps(body | change),)], "payload_json string")
        assert sync.validated(spoilt).first()["error"] == error


@pytest.mark.parametrize("body", [None, "5", "[]", "no", '{"messages":null}', '{"messages":"x"}', '{"messages":[1,null,{"content":5}]}', '{"messages":[{"role":"user","content":[null,3,{"type":"tool_result","tool_use_id":7}]}]}'])
def test_odd_bodies(spark, body):
    rows = messages.blocks(spark.createDataFrame([(1, body)], "id long, body string"), "id")
    assert messages.routed(rows, "id").count() >= 0


def test_last_call_wins(spark):
    use = lambda name: {"type": "tool_use", "id": "a", "name": name, "input": {"command": "x" * 70, "file_path": ""}}
    body = {"messages": [{"role": "assistant", "content": [use("Edit"), use("Bash")]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "p"}, {"type": "image"}, {"type": "text", "text": "q"}]}]}]}
    rows = messages.blocks(spark.createDataFrame([(1, json.dumps(body))], "id long, body string"), "id")
    r = messages.results(rows, "id").first()
    assert r["tool"] == "Bash" and r["label"] == "Bash: " + "x" * 60 + "…" and r["text"] == "pq"


SOURCE = """// adds up the fees of one merchant
import { load } from './rates';
interface Fee { amount: number; open: boolean }
const note = "the merchant has too many fees";
function feeOf(fee: Fee, rate: number): number {
  const base = fee.amount * rate;
  let total = 0;
  for (const k of [1, 2]) { total += k; }
  const pair = { base, other: total };
  return Math.min(base, total);
}
export class Fees { add(fee: Fee) { return feeOf(fee, 2); } }
"""


def test_code_renames_and_restores():
    names = code.Names()
    r = code.obfuscate(SOURCE, names)
    assert r.changed and r.comments == 1 and r.strings == 1
    words = code.forbidden_tokens(r.output)
    assert not words & {"feeOf", "Fee", "Fees", "total", "note", "pair"}
    assert {"load", "fee", "rate", "add", "Math", "k", "base"} <= words  # opaque, methods, globals and a shorthand's key stay
    redacted = code.redact(SOURCE, code.Names()).output
    assert code.restore(r.output, {s: o for s, o in names.back.items()}).replace("the merchant has too many fees", "str_1") == redacted
    assert code.obfuscate_known("feeOf and refeeOf", names) == f"{names.of['feeOf']} and refeeOf"


@pytest.mark.parametrize("bad", ["function (", "a ` b", "'open", "x }", "\x00"])
def test_what_does_not_scan_passes_through(bad):
    assert code.obfuscate(bad, code.Names()).output == bad


def test_long_files_pass_through():
    assert not code.obfuscate("x\n" * 10, code.Names(), max_lines=5).changed


def test_shadowing():
    src = "const a = 1;\nfunction f(a) { return a; }\nconst b = a;\n"
    out = code.obfuscate(src, code.Names()).output
    assert "(a) { return a; }" in out and "const a" not in out


def test_disguise_keeps_shape():
    d = code.disguise(SOURCE)
    s, t = code.shape(SOURCE), code.shape(d.output)
    assert all(s[k] == t[k] for k in code.COMPARED)
    assert d.domain in code.DOMAINS


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta"]), min_size=1, max_size=6))
def test_roundtrip_of_generated_code(names):
    src = "".join(f"const {n}{i} = {i};\n" for i, n in enumerate(names)) + "function run(x) { return " + " + ".join(f"{n}{i}" for i, n in enumerate(names)) + "; }\n"
    table = code.Names()
    assert code.restore(code.obfuscate(src, table).output, table.back) == src


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab_ 1", max_size=60), st.lists(st.integers(1, 9), max_size=12))
def test_frames_equal_the_whole(text, cuts):
    back = {"ab_1": "Original", "a_1": "Second"}
    tool, at, out = S.FrameRestorer(back, holdback=6), 0, []
    for n in [*cuts, 100]:
        body = {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text[at : at + n]}}
        at += n
        out += tool.push("data: " + json.dumps(body))
    out += tool.push('data: {"type":"content_block_stop","index":0}')
    said = "".join(json.loads(f.split("data: ")[1])["delta"]["text"] for f in out if "content_block_delta" in f)
    assert said == code.restore(text, back)


def test_frames_hold_arguments_and_pass_the_rest():
    tool = S.FrameRestorer({"v1": "real"})
    assert tool.push("event: ping") == ["event: ping"] and tool.push("data: {") == ["data: {"] and tool.push("data: 1\ndata: 2") == ["data: 1\ndata: 2"]
    for part in ('{"x":"v', '1"}'):
        assert tool.push("data: " + json.dumps({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": part}})) == []
    out = tool.push('data: {"type":"content_block_stop","index":1}')
    assert len(out) == 2 and '{\\"x\\":\\"real\\"}' in out[0]


def test_restore_json(spark):
    df = spark.createDataFrame([('{"a":["v1",{"v1":2}]}', {"v1": "x"}), ("not v1", {"v1": "x"}), (None, None)], "body string, m map<string,string>")
    assert [r[0] for r in df.select(rehydrate.restore_json(F.col("body"), F.col("m"))).collect()] == ['{"a":["x",{"v1":2}]}', "not x", None]


def test_comment_plans(spark):
    c = spark.createDataFrame([(1, ["shelf", "x"]), (2, ["none"]), (3, ["both"])], "comment_id int, words array<string>")
    p = spark.createDataFrame([(1, ["x"], ["shelf"], ["both"]), (2, [], [], ["both", "shelf"])], "plan_seq int, synthetics array<string>, glossary array<string>, vocabulary array<string>")
    assert {r["comment_id"]: (r["plan_seq"], r["score"]) for r in rehydrate.comment_scores(c, p).collect()} == {1: (1, 6), 2: (None, None), 3: (2, 1)}


def test_verdicts(spark):
    df = spark.createDataFrame([('{"suspicious":true,"quote":"odd","reason":"r"}', "so odd"), ('{"suspicious":true,"quote":"even","reason":"r"}', "so odd")], "output string, response string")
    assert [r["error"] for r in evaluate.verdicts(df).collect()] == [None, "quote missing"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("click", "h", f"2024-01-0{i % 3 + 1}T00:00:00.000Z", "s") for i in range(9)]
    events = spark.createDataFrame(rows, "category string, value_hash string, ts string, session_id string").withColumn("category", F.lit("comment"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = S.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("totals").collect()) == sorted(S.running_totals(events).collect())


def test_settings():
    assert Settings.from_env({"MASKWRIGHT_MAX_LINES": "7", "MASKWRIGHT_ENABLED": "false"}).max_lines == 7
    for env in ({"MASKWRIGHT_MODE": "x"}, {"MASKWRIGHT_MAX_LINES": "-1"}, {"MASKWRIGHT_ENABLED": "maybe"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)


def test_patterns_compile():
    for p in (*P.ENTITY_PATTERNS.values(), P.CAPITALIZED, P.PATH_FILE, P.PATH_DIR):
        re.compile(P.java(p))


def test_disguise_restores():
    d = code.disguise(SOURCE)
    assert d.valid, d.reason
    assert d.restore(d.output) == SOURCE
    assert not {"feeOf", "fee", "rate", "total"} & {t.text for t in code.scan(d.output)}


def test_bodies_of_a_session(spark):
    from maskwright.operators import requests as R

    numbered = "\n".join(f"{i + 1:6}\t{x}" for i, x in enumerate(SOURCE.split("\n")))
    use = lambda i, name, args: {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": name, "input": args}]}
    bodies = [
        json.dumps({"messages": [use("a", "Write", {"file_path": "x.ts", "content": SOURCE}), use("b", "Bash", {"command": "grep feeOf x.ts"}), {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "b", "content": "feeOf found"}]}]}),
        json.dumps({"messages": [use("c", "Read", {"file_path": "x.ts"}), {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c", "content": numbered}]}]}),
        "no json", None, '{"messages":[1,{"content":[{"type":"tool_use","name":5,"input":null}]}]}',
    ]
    df = spark.createDataFrame([("s", i, b) for i, b in enumerate(bodies)], "session string, number long, body string")
    got = {r["number"]: r for r in R.transform_bodies(df, "session", "number").collect()}
    first = json.loads(got[0]["output"])["messages"]
    assert "feeOf" not in got[0]["output"] and first[1]["content"][0]["input"]["command"].startswith("grep func_1")
    assert got[0]["labels"][0]["label"] == "x.ts" and got[0]["comments"] == 1 and got[0]["mapping"]["feeOf"] == "func_1"
    text = json.loads(got[1]["output"])["messages"][1]["content"][0]["content"]
    assert "func_1" in text and all(re.match(r"\s*\d+\t", x) for x in text.split("\n"))
    assert got[2]["output"] == "no json" and got[3]["output"] is None and got[4]["error"] is None
    coherent = {r["number"]: r for r in R.transform_bodies(df, "session", "number", mode="coherent").collect()}
    assert coherent[2]["error"] == "not json" and "feeOf" not in coherent[0]["output"].replace("grep feeOf", "").replace("feeOf found", "")


def test_disguises_are_dealt_over_tasks(spark, monkeypatch):
    """One small partition of many files is read by all tasks; a file is scanned once, as is its disguise."""
    made, real = [], code.scan
    monkeypatch.setattr(code, "scan", lambda x: made.append(x) or real(x))
    assert code.disguise(SOURCE).valid and len(made) == 2
    monkeypatch.undo()
    df = spark.createDataFrame([(i, SOURCE) for i in range(64)], "id long, source string").coalesce(1)
    out = code.disguise_files(df, "id", "source")
    assert out.select("id", F.spark_partition_id().alias("p")).agg(F.count_distinct("id"), F.count_distinct("p")).first()[:] == (64, 4)


def test_names_over_line_breaks_come_back(spark):
    """Spans hold the text's own white space; a name is one entity whatever stands between its words."""
    rows = [(1, "Dear  Anna \n Berg, The\tNova  Holdings met Anna Berg."), (2, "De De\nDe De\r\nDe De"), (3, "The\n\nMaria\tGomez")]
    out, made = pii.anonymize(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = {r["doc_id"]: r for r in out.withColumn("back", pii.restore_exact(out)).collect()}
    assert {k: r["back"] for k, r in got.items()} == dict(rows)
    assert all(r["text"][x["start"] : x["end"]] == x["value"] for r in got.values() for x in r["spans"])
    assert got[1]["sanitized_text"] == "Dear  Candidate_Alpha, The\tCompany_1 met Candidate_Alpha." and got[3]["sanitized_text"].startswith("The\n\nCandidate_")
    assert {r["real"] for r in made.collect()} == {"Anna Berg", "Nova Holdings", "De De De De", "De De", "Maria Gomez"}


def test_rows_of_a_session_do_not_grow_with_it(spark):
    """Each request's mapping has its own names; a session goes in order of its numbers over many batches."""
    from maskwright.operators import requests as R

    write = lambda i: json.dumps({"messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": "a", "name": "Write", "input": {"file_path": f"{i}.ts", "content": f"const own{i} = {i};\nfunction shared(x) {{ return own{i}; }}\n"}}]}]})
    df = spark.createDataFrame([(s, i, write(i)) for s in ("s", "t", None) for i in range(39, -1, -1)], "session string, number long, body string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for mode in ("pool", "coherent"):
            out = R.transform_bodies(df, "session", "number", mode=mode)
            rows = out.collect()
            assert len(rows) == 120 and all(r["error"] is None and set(r["mapping"]) <= {f"own{r['number']}", "shared", "x"} for r in rows)
            assert all(r["mapping"][f"own{r['number']}"] in r["output"] for r in rows)
            if mode == "pool":
                assert all(r["mapping"][f"own{r['number']}"] == f"var_{code._base36(r['number'] + 1)}" and r["mapping"]["shared"] == "func_1" for r in rows)
                assert R.session_names(out, "session").count() == 3 * 41
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def until(spark, q, table, rows, seconds=90):
    """Waits for rows: with timers by the clock a query never runs out of batches."""
    end = time.time() + seconds
    while time.time() < end and spark.table(table).count() < rows:
        time.sleep(0.5)
    q.stop()


def test_streams_with_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # the state server's messages
    rows = [(str(k), i, "data: " + json.dumps({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": t}})) for k in range(2) for i, t in enumerate(["say v", "1 now", " and v1 again, at some length"])]
    rows += [(str(k), 9, 'data: {"type":"content_block_stop","index":0}') for k in range(2)]
    frames = spark.createDataFrame(rows, "stream_id string, seq long, frame string")
    frames.write.parquet(f"{tmp_path}/f")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/f")
    q = S.restore_stream(stream, {"v1": "Maria"}).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    until(spark, q, "restored", 4)

    def said(found):
        out = {}
        for r in found:
            if "content_block_delta" in r["frame"]:
                out[r["stream_id"]] = out.get(r["stream_id"], "") + json.loads(r["frame"].split("data: ")[1])["delta"]["text"]
        return out

    want = said(S.restore_frames(frames, "stream_id", "seq", "frame", {"v1": "Maria"}).collect())
    assert said(spark.table("restored").collect()) == want == {k: "say Maria now and Maria again, at some length" for k in "01"}


def test_session_names_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("s", i, n) for i, n in enumerate(["a", "b", "a", "c", "a"])]
    names = spark.createDataFrame(rows, "session string, seq long, name string")
    names.coalesce(1).write.parquet(f"{tmp_path}/n")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(names.schema).parquet(f"{tmp_path}/n")
    q = S.mapping_stream(stream, capacity=2).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    until(spark, q, "numbered", 5)
    # the oldest inserted goes when the third name comes, so "a" is numbered anew
    assert [(r["name"], r["number"]) for r in spark.table("numbered").collect()] == [("a", 1), ("b", 2), ("a", 1), ("c", 3), ("a", 4)]


# ---- arrows, regular expressions, whole-file disguises


@pytest.mark.parametrize(
    "source,output",
    [
        ("const a = [1].map(total => total + 1);\nconst total = 5;", "const var_1 = [1].map(total => total + 1);\nconst var_2 = 5;"),
        ("const rate = 1; const f = rate => rate * 2; g(rate)", "const var_1 = 1; const var_2 = rate => rate * 2; g(var_1)"),
        ("const f = (a, b) => a + b + c;\nconst c = 2, a = 3;", "const var_1 = (a, b) => a + b + var_2;\nconst var_2 = 2, var_3 = 3;"),
        ("const z = xs.map(x => x * 2)\nconst x = 3\nprint(x)", "const var_1 = xs.map(x => x * 2)\nconst var_2 = 3\nprint(var_2)"),
        ("const f = x => ({ total: x, y });const total = 1, y = 2", "const var_1 = x => ({ total: x, y: var_2 });const var_3 = 1, var_2 = 2"),
        ("function g(h = rate => rate + 1) { const rate = 2; return h(rate); }", "function func_1(h = rate => rate + 1) { const var_1 = 2; return h(var_1); }"),
        ("const f = x => y => x + y; const x = 1, y = 2;", "const var_1 = x => y => x + y; const var_2 = 1, var_3 = 2;"),
        ("const f = async (x) => { const base = x; return base; };\nconst x = 1;", "const var_1 = async (x) => { const var_2 = x; return var_2; };\nconst var_3 = 1;"),
        ("if (x) /it's/.test(x);\nconst y = 1;", "if (x) /it's/.test(x);\nconst var_1 = 1;"),
        ("const k = (a / b) / 2, s = 'it';", "const var_1 = (a / b) / 2, var_2 = 'it';"),
    ],
)
def test_arrows_and_regular_expressions(source, output):
    assert code.obfuscate(source, code.Names()).output == output


def test_disguise_leaves_no_text_or_name():
    source = """// Acme payroll
import { load as fetchPay } from './payroll';
enum Plan { PayrollGold = 1, PayrollBasic }
function pay<TPayroll>(x: TPayroll, rate: number): string {
  const amount = Math.round(rate * 2);
  return `Acme payroll of ${amount} for Contoso staff`;
}
class Box<TItem extends object> { keep(item: TItem): TItem { return item; } }
const pick = <TRow>(row: TRow) => row;
console.log(pick(`${amountOf(3)}%`), new Map<string, Plan>());
"""
    d = code.disguise(source)
    assert not d.valid and d.reason == "real name left"  # amountOf is nobody's own and no name of the language
    d = code.disguise(source.replace("amountOf(3)", "fetchPay(3)"))
    assert d.valid and d.restore(d.output) == source.replace("amountOf(3)", "fetchPay(3)")
    for name in ("Acme", "Contoso", "payroll", "PayrollGold", "PayrollBasic", "Plan", "TItem", "TRow", "load", "fetchPay", "keep", "amount"):
        assert not re.search(rf"\b{name}\b", d.output), name
    assert "Math.round" in d.output and "console.log" in d.output and "new Map<string" in d.output
    assert d.glossary and set(d.glossary.values()) <= set(re.findall(r"\w+", source))


def test_events_of_protected_values(spark):
    import hashlib

    rows = [("s", "a.ts", "// who\nconst secretRate = 2;"), ("s", "b.ts", "const secretRate = 3;"), ("t", "c.ts", "const broken = (;"), ("t", "d.ts", None)]
    out = code.obfuscate_files(spark.createDataFrame(rows, "session string, path string, source string"), "session", "path", "source")
    got = sorted((r["session_id"], r["category"], r["value_hash"]) for r in audit.protected_events(out, "session", F.lit("2024-01-01T00:00:00.000Z")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([("s", "comment", sha("// who"))] + [("s", "identifier", sha("secretRate"))] * 2)


def test_a_session_too_big_for_a_task_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(code, "SESSION_BYTES", 10)
    import pyarrow as pa

    with pytest.raises(ValueError, match="more than 10"):
        code.check_size(pa.table({"x": ["a" * 100]}), "s")


# ---- stores, keys, connections


def test_key_is_made_once(tmp_path):
    store = keys.FileKeyStore(str(tmp_path / "key"))
    first = store.key()
    assert len(first) == 32 and keys.FileKeyStore(str(tmp_path / "key")).key() == first and (tmp_path / "key").stat().st_mode & 0o777 == 0o600
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError):
        keys.FileKeyStore(str(tmp_path / "short")).key()
    assert keys.authorized("a", "a") and not keys.authorized("ab", "a") and not keys.authorized(None, "a")


def test_connection_file(tmp_path):
    path = str(tmp_path / "c.json")
    assert logs.read_connection(path) is None
    logs.write_connection(path, "https://x.org", "t")
    assert logs.read_connection(path) == {"url": "https://x.org", "token": "t"} and (tmp_path / "c.json").stat().st_mode & 0o777 == 0o600
    for bad in ("{", "[]", '{"url":1,"token":"t"}'):
        (tmp_path / "c.json").write_text(bad)
        assert logs.read_connection(path) is None


def test_store_choice_and_sending(spark):
    assert logs.store_format("jdbc:postgresql://x") == "jdbc" and logs.store_format(None) == "parquet"
    with pytest.raises(ValueError):
        logs.store_format("", hosted=True)
    df, sent = spark.createDataFrame([("{}",), ("{}",)], "payload_json string"), []
    assert logs.send_payloads(df, lambda x: sent.append(x) or 202) == 2 and len(sent) == 2
    assert logs.send_payloads(df.limit(0), lambda x: 500) == 0
    with pytest.raises(RuntimeError):
        logs.send_payloads(df, lambda x: 500)


def test_ingest_statuses(spark, tmp_path):
    good = spark.createDataFrame([("x", "identifier", "ab" * 32, "2024-01-01T00:00:00.000Z")], "session_id string, category string, value_hash string, ts string")
    payloads = sync.build_payloads(good, F.lit("repo"), F.lit("2024-01-02T00:00:00.000Z"))
    rows, held = f"{tmp_path}/rows", f"{tmp_path}/quarantine"
    assert logs.ingest_request(payloads, "no", "token", rows, held) == 401
    assert logs.ingest_request(payloads, "token", "token", rows, held) == 202
    assert logs.ingest_request(spark.createDataFrame([("{}",)], "payload_json string"), "token", "token", rows, held) == 400
    assert [r["payload"]["totals"]["identifier"] for r in logs.read_store(spark, rows).collect()] == [1] and spark.read.parquet(held).count() == 1


def test_payload_parts_are_bounded(spark, monkeypatch):
    from maskwright.functions import patterns

    monkeypatch.setattr(patterns, "MAX_HASHES", 4)
    rows = [("s", "secret", f"{i:064x}", f"2024-01-0{1 + i % 3}T00:00:00.000Z") for i in range(10)]
    events = spark.createDataFrame(rows, "session_id string, category string, value_hash string, ts string")
    got = [json.loads(r["payload_json"]) for r in sync.build_payloads(events, F.lit("r"), F.lit("2024-01-09T00:00:00.000Z")).collect()]
    assert sorted(len(p["hashes"]) for p in got) == [2, 4, 4] and sum(p["totals"]["secret"] for p in got) == 10
    times = sorted(([h["timestamp"] for h in p["hashes"]] for p in got))
    assert [t for part in times for t in part] == sorted(t for part in times for t in part)


def test_summary_of_a_pass(spark, tmp_path):
    trials = spark.createDataFrame([("a", "completed", True), ("a", "completed", False), ("b", "failed", None)], "fixture_path string, status string, suspicious boolean")
    logs.write_pass_summary(trials, f"{tmp_path}/summary")
    got = {r["fixture_path"]: r for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert got["a"]["suspicion_rate"] == 0.5 and got["b"]["suspicion_rate"] is None and got["b"]["failed"] == 1


def test_requests_are_bounded_and_read(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("short\n" + "x" * 50 + "\n")
    good, bad = logs.read_requests(spark, str(tmp_path / "in.jsonl"), 10)
    assert [r[0] for r in good.collect()] == ["short"] and bad.count() == 1
    (tmp_path / "m.json").write_text('{"tuning":["a","b"],"heldOut":["c"]}')
    assert sorted(tuple(r) for r in evaluate.fixtures(logs.read_manifest(spark, str(tmp_path / "m.json"))).collect()) == [("a", "tuning"), ("b", "tuning"), ("c", "held-out")]
    logs.capture_raw(spark.createDataFrame([("raw body",)], "value string"), f"{tmp_path}/raw")
    assert spark.read.text(f"{tmp_path}/raw").first()[0] == "raw body"
    logs.write_trials(spark.createDataFrame([("f", 1)], "fixture string, run int"), f"{tmp_path}/trials")
    assert spark.read.json(f"{tmp_path}/trials").first()["fixture"] == "f"


# ---- streams, chunks, words


@given(st.text(max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_chunks_may_cut_anywhere(text, size):
    raw, tool, out = text.encode("utf-8", "replace"), S.ChunkDecoder(), []
    for i in range(0, len(raw), size):
        out += tool.push(raw[i : i + size])
    assert out + tool.flush() == [x for x in raw.decode().split("\n\n") if x]


def test_words_are_replaced_in_one_pass(spark):
    got = one(spark, "de the de_the then the.the de", X.replace_words(F.col("text"), {"the": "de", "de": "the"}))
    assert got == "the de de_the then de.de the" and one(spark, "x", X.replace_words(F.col("text"), {})) == "x"
    assert one(spark, "none here", X.replace_words(F.col("text"), {"a+b": "c"})) == "none here" and one(spark, "a+b c", X.replace_words(F.col("text"), {"a+b": "c"})) == "c c"


def test_urls_and_paths_for_display(spark):
    rows = [("https://U:p@Host.org:8080/a/b?k=1#x", "https://host.org:8080/a/b", "/a/b"), ("http://h", "http://h/", ""), ("nonsense", "[invalid URL]", "nonsense"), ("//evil/v1?x", "[invalid URL]", "/v1"), ("/v1/a#b", "[invalid URL]", "/v1/a")]
    for url, shown, path in rows:
        assert (one(spark, url, X.url_display(F.col("text"))), one(spark, url, X.log_path(F.col("text")))) == (shown, path)


def test_property_and_variable_roles():
    source = "interface A { n: number; b: boolean; e: 'x' | 'y'; o: Date }\nlet sum = 0; sum += 1;\nconst top = Math.max(1, 2), gap = a - b, on = a > b, same = a;"
    found = {d.name: d.role for d in code.analyze(code.scan(source)).declarations}
    assert found == {"A": None, "n": "number", "b": "boolean", "e": "enum", "o": "other", "sum": "accumulator", "top": "clamped", "gap": "difference", "on": "boolean", "same": "passthrough"}


def test_domain_choice():
    plain = dict.fromkeys(code.SHAPE, 0)
    cases = [({"classes": 1}, "inventory"), ({"enum_arity": 4}, "routing"), ({"branches": 3}, "routing"), ({"numbers": 5, "booleans": 1}, "scheduling"), ({"strings": 1}, "publishing"), ({}, "forecasting")]
    assert all(code.choose_domain(plain | s) == d for s, d in cases) and code.choose_domain(plain, "routing") == "routing"


def test_stealth_names_count_by_role():
    names = code.Names("stealth")
    got = [names.named(n, "variable", r, set()) for n, r in (("a", "clamped"), ("b", "clamped"), ("c", "boolean"), ("d", None))]
    assert got == ["clampedFirstLedger", "clampedSecondLedger", "booleanFirstLedger", "firstLedger"]


def test_nothing_is_sent_that_was_not_recorded(spark, caplog):
    df, calls = spark.range(1), []

    def broken(_):
        raise OSError("full")

    logs.record_then_sync(df, broken, lambda _: calls.append("sent"))
    assert not calls and "aren't sent" in caplog.text
    logs.record_then_sync(df, lambda _: calls.append("recorded"), broken)
    assert calls == ["recorded"] and "weren't sent" in caplog.text
