"""The corpus operators against brute force, round trips and odd inputs."""

import collections
import itertools
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontamination as D
from maskwright.llm import html_extraction as H
from maskwright.llm import jaccard_join as J
from maskwright.llm import line_dedup as L
from maskwright.llm import packing as K
from maskwright.llm import pseudo_likelihood as M
from maskwright.llm import quality as Q
from maskwright.llm import quality_classifier as C
from maskwright.llm import sharding as S
from maskwright.llm import tokens as T
from maskwright.llm.components import components
from maskwright.llm.queries import oracle_sql, queries
from maskwright.llm.shared import KeyFilter
from maskwright.llm.shingles import shingle_hashes, shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(120_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "one", "en", None, 3), (None, "no id but some words here to be read by all of us today", "en", "s", None),
    (5, "Ünïcode ünd 日本語 \U0001f600 text", "de", "s", 9), (6, LONG, "en", "s", len(LONG)), (7, "same same same", "en", "s", 1), (7, "same same same", "en", "s", 1), (8, "<|endoftext|> a՘b", "en", "s", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("key", "token", "kept", "shard", "n_tokens", "places", "score", "comp", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


# ---- shared parts


def test_hashes_follow_the_word_rule():
    for text in ("a  b\tC d\x0be", "", " ", "É é", "x" * 70, "a b " * 9):
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORD.findall(text)]
        h = word_hashes(text)
        assert len(h) == len(w) and len(set(h.tolist())) == len(set(w))
        assert [len({i for i, y in enumerate(w) if y == x}) for x in w] == [int((h == y).sum()) for y in h]


def test_long_texts_hash_as_their_parts(monkeypatch):
    from maskwright.llm import shingles as X

    whole = word_hashes(LONG)
    monkeypatch.setattr(X, "PART", 1000)
    assert (word_hashes(LONG) == whole).all() and len(whole) == 120_000
    many = X.words_and_endings_of(["a b", None, "", "c"])
    assert many[2].tolist() == [2, 0, 0, 1] and (many[0] == word_hashes("a b c")).all()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (20, 21)], "a long, b long")
    assert {r["node"]: r["comp"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}
    assert components(links.limit(0)).count() == 0


def test_filter_has_no_false_no(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)
    test = KeyFilter(spark.createDataFrame([(int(k),) for k in [*keys, 0, 32767, 32768, -1]], "k long"), "k").tester()
    assert test(np.array([*keys, 0, 32767, 32768, -1])).all()
    assert test(np.arange(10**6, 10**6 + 1000)).sum() < 20


# ---- 1


def test_sharding(spark, docs, odd):
    got = S.op1_sharding(spark, SF).collect()
    assert len(got) == docs.count()
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # as near equal as the slots allow: a shard is over the mean by no more than its largest slot
    weights = collections.Counter()
    for r in got:
        weights[r["vslot"]] += r["size"]
    assert max(loads.values()) <= 1.001 * sum(loads.values()) / 24 + max(weights.values()) / 2 and {r["map_version"] for r in got} == {2}
    out, _ = S.shard_records(odd, 3)
    rows = {(r["doc_id"], r["text_crc32"]): r["size"] for r in out.collect()}
    assert rows[1, 0] == 8 and rows[2, 0] == 8 and rows[5, zlib.crc32(ODD[5][1].encode())] == len(ODD[5][1].encode()) + 8
    assert out.count() == len(ODD) and S.shard_records(odd.limit(0), 3)[0].count() == 0


def test_stored_map_is_edited(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/map"
    first, made = S.shard_records(docs, 6, folder)
    again, same = S.shard_records(docs, 6, folder)
    assert made.version == same.version == S.SlotMap.load(spark, folder).version == 2
    assert S.SlotMap.load(spark, folder, 1).shards == S.SlotMap.initial(S.N_SLOTS, 6).shards and S.SlotMap.load(spark, folder, 9) is None
    where = lambda df: {r["doc_id"]: r["shard"] for r in df.collect()}
    before = where(first)
    assert before == where(again)
    more, grown = S.shard_records(docs, 7, folder)
    moved = {d for d, shard in where(more).items() if shard != before[d]}
    assert grown.version == 3 and grown.n_shards == 7 and 0 < len(moved) < len(before) / 3
    blank = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert S.digest(blank).select("vslot").distinct().count() > 1500  # rows without an id don't meet in one slot


def test_slot_map_edits():
    w = list(np.random.default_rng(1).integers(1, 100, 512))
    first = S.SlotMap.balanced(w, 8)
    more = first.rebalanced(w, 9)
    assert more.version == 2 and sum(m[2] != 8 for m in more.moved) <= 4 and len(more.moved) < 120
    assert all(a == b for i, (a, b) in enumerate(zip(first.shards, more.shards, strict=True)) if i not in {m[0] for m in more.moved})
    w[:40] = [900] * 40
    again = more.rebalanced(w, 9)
    load = lambda m: [sum(x for x, s in zip(w, m.shards, strict=True) if s == k) for k in range(9)]
    assert max(load(again)) <= max(load(more))
    with pytest.raises(ValueError):
        first.rebalanced(w, 4)


# ---- 2


def test_decontamination_equals_brute_force(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    bags = {i: list(zip(*[t.encode().lower().split()[k:] for k in range(5)], strict=False)) for i, t in items.items()}
    want = set()
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        g = list(zip(*[w[k:] for k in range(5)], strict=False))
        for i, bag in bags.items():
            n, have = len(bag), collections.Counter(bag)
            at = [k for k, x in enumerate(g) if x in have]
            for s in {max(0, k - n) + j for k in at for j in range(n + 1)}:
                part = collections.Counter(g[s : s + n])
                if sum(part.values()) == n and sum((part & have).values()) >= 0.75 * sum((part | have).values()):
                    want.add((d, i))
                    break
    got = D.op2_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    clean = {r["doc_id"] for r in D.clean_documents(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert clean == set(texts) - {d for d, _ in want}


def test_documents_shorter_than_items_equal_brute_force(spark):
    items = {r["item_id"]: r["text"].encode().lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    bag = lambda w: collections.Counter(zip(*[w[k:] for k in range(5)], strict=False))
    texts = {100 * i + k: w[:-k] if k % 2 else w[k:] for i, w in items.items() for k in range(1, 12) if len(w) - k > 4}
    want = {(d, i) for d, w in texts.items() for i, x in items.items() if len(w) < len(x) and (bag(w) & bag(x)).total() >= 0.75 * (bag(w) | bag(x)).total()}
    docs = spark.createDataFrame([(d, b" ".join(w).decode()) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    lengths = {i: len(w) for i, w in items.items()}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect() if len(texts[r["doc_id"]]) < lengths[r["item_id"]]}
    assert got == want and len(want) > len(items)
    assert not {d for d, _ in want} & {r["doc_id"] for r in D.clean_documents(docs, bench).collect()}


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(5)
    table = D.Tables(D.RADIUS)
    prints = [int(x) for x in rng.integers(0, 2**63, 300)]
    for k, p in enumerate(prints):
        table.add(k, collections.Counter(), p)
    for p in prints[:60]:
        q = p
        for b in rng.choice(64, D.RADIUS, replace=False):
            q ^= 1 << int(b)
        assert {k for k, _ in table.within(q)} == {k for k, x in enumerate(prints) if (x ^ q).bit_count() <= D.RADIUS}


def test_near_windows_and_odd_rows(spark, odd):
    item = " ".join(f"word{i}" for i in range(60))
    near = item.replace("word30", "other")
    far = " ".join(x if i % 6 else "zz" for i, x in enumerate(item.split()))
    tool = D.Detector([(1, item), (2, None), (3, ""), (4, "two words")])
    assert [x[0] for x in tool.find("before it " + near + " after")] == [1] and not tool.find(far) and not tool.find(None)
    assert len(tool.find(item + " x " + item)) == 2 and tool.find("here two words are")[0][:3] == (4, 1, 2)
    bench = spark.createDataFrame([(9, "some words here to be read by all of us today"), (None, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(odd, bench).collect()] == [(None, 9)]
    kept = D.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert D.clean_documents(odd.limit(0), bench).count() == 0 and D.clean_documents(odd, bench.limit(0)).count() == len(ODD)


# ---- 3, 6


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def check_pieces(pieces, want):
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    for ps in by_window.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= K.WINDOW
    for d, ids in want.items():
        got = [x for p in sorted(by_doc[d], key=lambda p: p["start"]) for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert got == ids
    return sum(p["length"] for p in pieces) / (K.WINDOW * len(by_window))


def test_packing_round_trip(spark, docs, texts, library):
    pieces = K.pack(docs.repartition(3), T.vocabulary_path()).collect()
    assert check_pieces(pieces, {d: ids_of(library, t) + [1] for d, t in texts.items()}) > 0.95


def test_packing_odd_rows(spark, odd, library):
    pieces = K.pack(odd, T.vocabulary_path()).collect()
    want = {d: ids_of(library, t) + [1] for d, t, *_ in ODD if d != 7}
    check_pieces([p for p in pieces], want)
    assert sum(p["length"] for p in pieces if p["doc_id"] == 7) == 2 * (len(ids_of(library, "same same same")) + 1)
    assert K.pack(odd.limit(0), T.vocabulary_path()).count() == 0


def test_token_counts(spark, texts, odd, library):
    got = {r["doc_id"]: r for r in T.op6_token_counts(spark, SF).collect()}
    assert {d: r["n_tokens"] for d, r in got.items()} == {d: len(ids_of(library, t)) for d, t in texts.items()}
    out = T.count_tokens(odd, T.vocabulary_path())
    assert sorted(out.columns) == sorted(odd.columns)
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(ids_of(library, t)) for _, t, *_ in ODD)
    assert T.count_tokens(odd.limit(0), T.vocabulary_path()).count() == 0


def test_both_token_engines_agree_on_all_code_points(library):
    tool = T.counter(T.vocabulary_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for k, c in enumerate(points) if k < 0x20000 or k % 64 == 0]  # ideographs above are one run
    samples = [f"a{c}b 1{c}2 {c}{c}. {c} x" for c in points]
    want = [e.ids for e in library.encode_batch_fast(samples, add_special_tokens=False)]
    assert tool.counts(samples) == list(map(len, want))
    assert all(T.encode(s, T.vocabulary_path()).tolist() == w for s, w in zip(samples, want, strict=True))
    common = re.compile(T.COMMON)
    assert not any(T.unassigned().search(c) for c in points if common.match(c))


@pytest.mark.parametrize("run", [" ", "\n", "\t "])
def test_a_million_spaces(library, run):
    text = "a" + run * 1_000_000 + "b"
    assert T.encode(text, T.vocabulary_path()).tolist() == ids_of(library, text)


# ---- 4


def test_quality_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(Q.OP4_SQL)
    got = Q.op4_quality_rules(spark, SF)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_quality_odd_rows(spark, odd):
    out = Q.judge(odd, keep_features=("n_words", "n_repeat_words"))
    rows = {(r["doc_id"], r["n_words"]): r for r in out.collect()}
    assert rows[1, 0]["kept"] is False and rows[6, 120_000]["kept"] is True and rows[None, 14]["kept"] is True
    kept = Q.filter_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {6, None}
    assert Q.filter_documents(odd.limit(0)).count() == 0


def test_cascade_order_changes_nothing(spark, docs):
    rules = Q.BASE_RULES + Q.RULES
    a, b = ({r["doc_id"] for r in Q.judge(docs, rules, order=o).filter("kept").select("doc_id").collect()} for o in (list(rules), list(rules)[::-1]))
    assert a == b and a
    ranks = [c.rank for c in Q.measure(docs, rules)]
    assert ranks == sorted(ranks, reverse=True)


def test_rejected_rows_skip_later_rules(spark, docs):
    """A later rule, and the features that it alone needs, aren't evaluated where an earlier one rejects."""
    dear = Q.Rule("dear", "CASE WHEN {n_words} < 60 THEN raise_error('evaluated') ELSE false END")
    first = Q.Rule("first", "{n_words} < 60")
    assert 0 < Q.filter_documents(docs, order=[first, dear]).count() < docs.count()
    with pytest.raises(Exception, match="evaluated"):
        Q.filter_documents(docs, order=[dear, first]).count()
    wide = Q.cascade(docs, [first, *Q.RULES]).cache()
    skipped = wide.filter("__q_verdict = 'first'")
    assert skipped.count() and not skipped.filter("__q_n_stutter IS NOT NULL OR __q_n_symbols IS NOT NULL").count()
    wide.unpersist()


def test_quality_runs_no_python(spark):
    plan = Q.op4_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 5


def test_join_equals_brute_force(spark, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = groups(sets)
    got = {r["doc_id"]: r for r in J.op5_jaccard_join(spark, SF).collect()}
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_join_of_many_near_copies(spark, monkeypatch):
    """A large group near the threshold, small sets, chains and shared passages, in few partitions and many."""
    rng = np.random.default_rng(2)
    base, passage = [f"b{i}" for i in range(90)], " ".join(f"p{i}" for i in range(40))
    rows = {}
    for i in range(70):
        w = list(base)
        for k in rng.choice(90, rng.integers(0, 4), replace=False):
            w[k] = f"e{i}_{k}"
        rows[i] = " ".join(w)
    for i in range(70, 100):
        rows[i] = passage + " " + " ".join(f"u{i}_{k}" for k in range(rng.integers(0, 60)))
    for i in range(100, 140):
        rows[i] = " ".join(f"s{k}" for k in range(rng.integers(1, 13)))
    want = groups({d: shingles(t) for d, t in rows.items()})
    for parts, boundary in ((1, None), (7, 40)):
        if boundary:
            monkeypatch.setattr(J, "choose_boundary", lambda *a, b=boundary: b)
            monkeypatch.setattr(J, "KEYS_MOST", 0)  # too many keys to broadcast
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(parts)
        assert {r["doc_id"]: r["component_id"] for r in J.linked(df).collect()} == want


def test_overlap_bound_is_a_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert J.overlap_bound(J.sketch(x), len(x), J.sketch(y), len(y)) >= len(np.intersect1d(x, y))


def test_join_odd_rows(spark, odd):
    rows = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.linked(odd).collect()), key=str)
    assert rows == sorted([(0, 10, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (6, 119_996, 6), (7, 1, 7), (7, 1, 7), (8, 1, 8)], key=str)
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert J.one_of_each(odd.limit(0)).count() == 0
    assert len(shingle_set(None)) == 0 and len(shingle_hashes(word_hashes("a b"))) == 1


# ---- 7


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in C.op7_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == y[r["doc_id"]] for r in rows) / len(rows) > 0.95


def test_linear_time_identity():
    m = C.FactorisationMachine.untrained()
    at, x = C.features("some words and some more", 24)
    v = m.factors[at].astype(float)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i, j in itertools.combinations(range(len(at)), 2))
    assert m.margin(at, x) == pytest.approx(m.linear[at] @ x + pairs, abs=1e-4)


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    machine = C.train(odd, labels)
    got = C.score(odd, machine).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in C.score(odd, C.train(odd, labels.limit(0))).collect()} == {0.5}
    assert C.score(odd.limit(0), machine).count() == 0


# ---- 8


def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    net = M.Network.started(rng.integers(0, 50, M.VOCABULARY).astype(float))
    c = rng.integers(0, M.VOCABULARY + 1, (1, 4))
    every = net.log_probabilities(np.repeat(c, M.VOCABULARY, 0), np.arange(M.VOCABULARY))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    c, t = rng.integers(0, M.VOCABULARY, (64, 4)), rng.integers(0, M.VOCABULARY, 64)
    before, memory = net.log_probabilities(c, t).mean(), np.zeros_like(net.flat)
    for _ in range(30):
        net.train(c, t, memory)
    assert net.log_probabilities(c, t).mean() > before + 1


def test_pseudo_likelihood_beats_frequencies(spark, docs):
    known, counts = M.vocabulary(docs)
    p = counts / counts.sum()
    rows = M.score(docs, *M.train(docs)).collect()
    n = sum(r["n_tokens"] for r in rows)
    assert n == counts.sum() and sum(r["log_likelihood"] for r in rows) / n > (p[p > 0] * np.log(p[p > 0])).sum()
    assert len(known) == min(M.WORDS, len(known))


def test_every_token_trains(spark, monkeypatch):
    # texts of two words: a stride longer than a text used to give most of them no target
    rows = [(i, f"alone{i} alone{i}") for i in range(20)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen = []
    mean = M._mean
    monkeypatch.setattr(M, "_mean", lambda found: seen.append(sum(r["n"] for r in found)) or mean(found))
    M.train(df)
    assert seen == [40] * M.ROUNDS


def test_trainer_takes_every_target_once(monkeypatch):
    rng, sizes = np.random.default_rng(1), []
    monkeypatch.setattr(M.Network, "train", lambda self, c, t, m: sizes.append(len(t)))
    trainer = M.Trainer(np.zeros(sum(M._SIZES.values()), np.float32))
    total = 0
    for n in (5, 0, 90_000, 3, 700):
        trainer.add(rng.integers(0, 9, (n, 4)), rng.integers(0, 9, n))
        total += n
    trainer.finish()
    assert sum(sizes) == trainer.seen == total and max(sizes) == M.BATCH_MOST and sizes[0] == M.BATCH


def test_log_likelihood_equals_brute_force(spark, docs, texts):
    """The shipped setting, token by token in plain Python: softmax over groups, over members, counts of words."""
    words = M.word_counts(docs).cache()
    known, net = M.train(docs, words=words)
    got = {r["doc_id"]: r["log_likelihood"] for r in M.score_words(docs, known, net, words).collect()}
    n = {r["word"]: (r["bucket"], r["n"]) for r in words.collect()}
    place, sizes = {w: i for i, w in enumerate(known.view(np.int64).tolist())}, collections.Counter()
    for w, (b, k) in n.items():
        sizes[b] += k * (w not in place)
    soft = lambda z, i: z[i] - np.log(np.exp(z - z.max()).sum()) - z.max()
    for d in sorted(texts, key=lambda d: (len(texts[d] or ""), d))[:: len(texts) // 8]:
        hashes = word_hashes(texts[d]).view(np.int64).tolist()
        ids = [M.VOCABULARY] * M.SIDE + [place.get(w, M.WORDS + n[w][0]) for w in hashes] + [M.VOCABULARY] * M.SIDE
        total = 0.0
        for k, w in enumerate(hashes[:400]):
            e = np.concatenate([net.embedding[ids[k + M.SIDE + s]] for s in M.SLOTS]).astype(float)
            h = np.append(np.tanh(e @ net.slots + net.bias), 1.0)
            g, m = divmod(ids[k + M.SIDE], M.MEMBERS)
            total += soft(h @ net.groups, g) + soft(h @ net.members[g], m)
            total += np.log(n[w][1] / (sizes[n[w][0]] + 1)) if w not in place else 0
        if len(hashes) <= 400:
            assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_a_score_works_in_small_parts():
    """Targets scored at once are worked on a part at a time, whatever their order, and score as one by one."""
    import tracemalloc

    rng = np.random.default_rng(8)
    net = M.Network.started(rng.integers(0, 900, M.VOCABULARY).astype(float))
    net.flat += rng.normal(0, 0.5, len(net.flat)).astype(np.float32)
    c, t = (rng.integers(0, M.VOCABULARY + 1 - k, (M.SCORED, 4) if not k else M.SCORED).astype(np.int16) for k in (0, 1))
    net.log_probabilities(c[:9], t[:9])
    tracemalloc.start()
    got = net.log_probabilities(c, t)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < M.SCORED * M.MEMBERS * 4  # less than a single table of the members' probabilities of all targets
    for k in range(0, M.SCORED, 997):
        h = np.append(np.tanh(net.embedding[c[k]].reshape(-1).astype(float) @ net.slots + net.bias), 1.0)
        g, m = divmod(int(t[k]), M.MEMBERS)
        want = sum(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, i in ((h @ net.groups, g), (h @ net.members[g], m)))
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert len(net.log_probabilities(c[:0], t[:0])) == 0


def test_words_of_a_bucket_score_apart(spark, docs, texts, odd, monkeypatch):
    words = M.word_counts(docs).cache()
    known, model = M.train(docs, words=words)
    plain = {r["doc_id"]: r for r in M.score(docs, known, model).collect()}
    full = {r["doc_id"]: r for r in M.score_words(docs, known, model, words).collect()}
    n = {r["word"]: (r["bucket"], r["n"]) for r in words.collect()}
    own, sizes = set(known.view(np.int64).tolist()), collections.Counter()
    for w, (b, k) in n.items():
        sizes[b] += k * (w not in own)
    assert set(full) == set(plain) == set(texts)
    for d, t in texts.items():
        want = sum(np.log(n[w][1] / (sizes[n[w][0]] + 1)) for w in word_hashes(t).view(np.int64).tolist() if w not in own)
        assert full[d]["n_tokens"] == plain[d]["n_tokens"] and full[d]["log_likelihood"] == pytest.approx(plain[d]["log_likelihood"] + want, rel=1e-6, abs=1e-4)
    assert M.score_words(odd, known, model, words).count() == len(ODD)
    # a table that holds few words: the others are joined, with the same sums
    monkeypatch.setattr(M, "TABLE", 50)
    joined = {r["doc_id"]: r for r in M.score_words(docs, known, model, words).collect()}
    assert len(M.common_words(words)[0]) <= 50 and set(joined) == set(full)
    assert all(joined[d]["log_likelihood"] == pytest.approx(r["log_likelihood"], rel=1e-9, abs=1e-6) for d, r in full.items())


def test_pseudo_likelihood_odd_rows(spark, odd):
    got = M.score(odd, *M.train(odd)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 0 and by[1]["log_likelihood"] == 0 and by[1]["mean_log_probability"] is None and by[6]["n_tokens"] == 120_000
    assert M.score(odd.limit(0), *M.train(odd.limit(0))).count() == 0


def test_averages_go_in_a_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 2)
    known, model = M.train(docs.repartition(7), rounds=1)
    assert np.isfinite(model.flat).all()


# ---- 9


def test_pages_give_their_articles(spark):
    import html

    for r in H.op9_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


PROSE = "This is a long paragraph of the article, with commas, full stops and so on. It says more than any menu does."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>a</p>", "a"), ("<!-- x", ""), ("<script>var a = '<p>no</p>'", ""), ("<a href=\"x", ""),
        (f"<nav><a>Home</a></nav><div id=main><h2>Title</h2><p>{PROSE}</p></div><footer>f</footer>", f"Title\n\n{PROSE}"),
        (f"<article><header>by me</header><p>{PROSE}<p>Two&nbsp;&amp;&#33;<aside>no</aside></article><div class='user-comments'><p>{PROSE}</p></div>", f"{PROSE}\n\nTwo &!"),
        (f"<main><form><p>{PROSE}</p></form><p>Yes,\n it\tis.</p><div class=\"cookie-notice\">c</div></main>", "Yes, it is."),
        (f"<div class=page><article><p>{PROSE}</p></article><article class=comment><p>{PROSE} {PROSE}</p></article></div>", PROSE),
        (f"<form id=aspnetForm><nav>Home</nav><article><h1>T</h1><p>{PROSE}</p></article></form>", f"T\n\n{PROSE}"),
        (f"<form><p>{PROSE}</p><p>Short.</p></form>", f"{PROSE}\n\nShort."),
        (f"<div class='share-price-report'><p>{PROSE}</p></div><div class='share-buttons'>Tweet</div>", PROSE),
        (f"<div class='siteHeader'>Brand</div><div class='post'><h2>T</h2><p>{PROSE}</p><div class='related-posts'><p>{PROSE}</p></div></div><div id='footer_links'>x</div>", f"T\n\n{PROSE}"),
        (f"<div><a>Home</a><a>About</a></div><div><div><p>{PROSE}</p><p>{PROSE}</p><h3>Sub</h3><p>End.</p></div></div><div>Small print</div>", f"{PROSE}\n\n{PROSE}\n\nSub\n\nEnd."),
        (f"<main><article><p>Teaser, one.</p></article><article><h1>T</h1><p>{PROSE}</p></article></main>", f"Teaser, one.\n\nT\n\n{PROSE}"),
        (f"<div role=navigation><p>{PROSE}</p></div><section><p>{PROSE} Yes.</p></section><section class='reader-comments'><article><p>{PROSE}</p></article></section>", f"{PROSE} Yes."),
        ("<article><ul><li>x<li>y</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "x\n\ny\n\na\n\nb\n\nc"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_ratios_find_the_article_by_themselves(spark, monkeypatch):
    """Recall and precision by page where nothing names the article, nor any menu, advert or footer."""
    plain = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = H.main_text(r["html"])
        plain[re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")] = text
    monkeypatch.setattr(H, "BOILER", frozenset())
    monkeypatch.setattr(H, "BOILER_WORDS", frozenset())
    recall, precision = [], []
    for page, text in plain.items():
        want, got = collections.Counter(text.split()), collections.Counter(H.main_text(page).split())
        recall.append((want & got).total() / max(1, want.total()))
        precision.append((want & got).total() / max(1, got.total()))
    assert np.mean(recall) > 0.97 and np.mean(precision) > 0.9
    monkeypatch.setattr(H, "content_paths", lambda found: {b.path for b in found})
    assert sum(H.main_text(page) == text for page, text in plain.items()) < sum(r == p == 1 for r, p in zip(recall, precision, strict=True))


def test_many_nested_elements_take_linear_time():
    page = "<div>" * 20_000 + "<p>text.</p>" * 2_000
    assert H.main_text(page).count("text.") == 2_000


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a", "y"), (1, None, None, "x"), (2, "u", "<b>" * 30_000 + "deep", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract(df).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "deep", 4)]
    assert H.extract(df.limit(0)).count() == 0


# ---- 10


def masked(line):
    low = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line))
    out = tuple("<*>" if re.search(r"[0-9@]|://", t) else t for t in low)
    return tuple(low) if set(out) == {"<*>"} else out


def test_lines_equal_brute_force(spark, texts):
    """The tree by plain Python: leaves by size and first tokens, lines in order of their hash."""
    owners, hashes = collections.defaultdict(set), {}
    for d, t in texts.items():
        x = L.parse(t)
        lines = (t or "").split("\n")
        for k, h in zip(x.place.tolist(), x.line.view(np.int64).tolist(), strict=True):
            m = masked(lines[k])
            assert hashes.setdefault(h, m) == m
            owners[h].add(d)
    template, leaves = {}, collections.defaultdict(list)
    for h in sorted(owners):
        m = hashes[h]
        found = None
        if len(m) > L.places(len(m)):
            pool = leaves[len(m), m[: L.DEPTH]]
            best = max(pool, key=lambda p: (sum(a == b for a, b in zip(p[1], m, strict=True)), -pool.index(p)), default=None)
            if best and sum(a == b for a, b in zip(best[1], m, strict=True)) >= L.places(len(m)):
                found = best[0]
                best[1][:] = [a if a == b else None for a, b in zip(best[1], m, strict=True)]
            else:
                pool.append((h, list(m)))
        template[h] = h if found is None else found
    docs_of, kinds = collections.defaultdict(set), collections.defaultdict(set)
    for h, ds in owners.items():
        docs_of[template[h]] |= ds
        kinds[template[h]].add(h)
    by_mask = {m: h for h, m in hashes.items()}

    def stays(d, line):
        h = by_mask.get(masked(line))
        if h not in template:
            return True
        t = template[h]
        return len(docs_of[t]) < (L.MIN_DOCS if len(kinds[t]) == 1 else L.MIN_DOCS_GENERAL) or min(docs_of[t]) == d

    for r in L.op10_line_dedup(spark, SF).collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for x in t.split("\n") if stays(r["doc_id"], x)))


def test_variable_fields_and_first_copy(spark):
    rows = [(i, f"Order {i} was sent to box {i * 7} on day {i}\nown line of document number {'abcdefgh'[i]} here\nok") for i in range(1, 6)]
    out = {r["doc_id"]: r["text"] for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Order 1" in out[1] and not any("Order" in out[i] for i in range(2, 6))
    assert [i for i, t in out.items() if t.endswith("ok")] == [1]  # short lines are lines like others
    every = {r["text"] for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False).collect()}
    assert not any("Order" in t for t in every)


def test_lines_odd_rows(spark, odd):
    out = L.drop_lines(odd, counts=True)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and dict(out.dtypes)["n_dropped"] == "bigint"
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(d), str(t)) for d, t, *_ in ODD)
    empty = L.drop_lines(odd.limit(0))
    assert empty.columns == odd.columns and empty.count() == 0


def test_dropped_lines_of_odd_rows(spark):
    """Repeated rows are one document, null ids come first, short lines and bare fields are lines too."""
    rows = [(1, "x y z\nok\n77"), (1, "x y z\nok\n77"), (2, "own\nx y z\r\n78"), (None, "ok\nmine"), (None, "ok\nmine"), (3, "77\n 1 2 "), (4, "1 2"), (5, None), (6, "own")]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "x y z\n77")] * 2 + [("2", "own\n78"), ("None", "ok\nmine"), ("None", "ok\nmine"), ("3", " 1 2 "), ("4", ""), ("5", "None"), ("6", "")])


def test_leaf_finds_what_all_templates_would():
    rng = np.random.default_rng(6)
    leaf, pool = L.Leaf(L.SIMILAR), []
    for key in range(600):
        row = rng.integers(1, 4, 12).astype(np.uint64) if key % 3 else pool[int(rng.integers(len(pool)))][2] if pool else np.ones(12, np.uint64)
        row = np.where(rng.random(12) < 0.1, np.uint64(99), row)
        same = [(int((r == row).sum()), -i) for i, (_, r, _) in enumerate(pool)]
        best = max(same, default=(0, 0))
        if best[0] >= L.places(12):
            pool[-best[1]][1][pool[-best[1]][1] != row] = 0
            want = pool[-best[1]][0]
        else:
            pool.append((key, row.copy(), row))
            want = key
        assert leaf.add(key, row) == want
    assert 1 < len(pool) < 600


def test_big_leaves_are_split(spark):
    words = ["red", "green", "blue", "white"]
    rows = [(i, "\n".join(f"the one line {words[i % 4]} {words[k % 4]} {chr(97 + k)} {chr(97 + i)} goes on and on here" for k in range(8))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {tuple(x.split()) for _, t in rows for x in t.split("\n")}
    text = lambda **o: {r["doc_id"]: r["text"] for r in L.drop_lines(df, **o).collect()}
    # 96 lines in one leaf; by the fourth token 24 each, by the fifth 6
    assert len(lines) == 96 and text(leaf_most=6) == text(depth=5) and text(leaf_most=24) == text(depth=4)


def test_templates_do_not_depend_on_the_leafs_size(spark):
    """Lines that differ in their fourth token are one template, however many others lie in their leaf."""
    rng = np.random.default_rng(3)
    rows = [(i, f"the one line {w} goes on and on here now\nmine {w}") for i, w in enumerate(("red", "green", "blue"))]
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    others = ["the one line " + " ".join(map(word, x)) for x in rng.integers(0, 400_000, (20_100, 7)).tolist()]
    text = lambda rows: {r["doc_id"]: r["text"] for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 3").collect()}
    few = text(rows)
    assert few[0] == rows[0][1] and few[1] == "mine green" and few[2] == "mine blue"
    assert text([*rows, (3, "\n".join(others))]) == few


def test_line_stage_does_not_depend_on_the_leafs_size(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    text = lambda n: " ".join(map(word, rng.integers(0, 400_000, n).tolist()))
    rows = [(i, f"the one line {w} goes on and on here now\n{text(30)}") for i, w in enumerate(("red", "green", "blue", "white"))]
    others = [(4, "\n".join("the one line " + text(7) for _ in range(20_100)))]
    stage = lambda rows: {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").filter("doc_id < 4").collect()}
    few = stage(rows)
    assert few == {i: t if i == 0 else t.split("\n")[1] for i, t in rows} and stage(rows + others) == few


def test_leaves_are_dealt_out_without_a_change(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join("a b c " + " ".join(map(str.strip, map(chr, 97 + rng.integers(0, 3 + i % 5, n)))) for n in (2, 3, 7, 7, 12))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = lambda: {r["doc_id"]: r["text"] for r in L.drop_lines(df).collect()}
    whole = text()
    monkeypatch.setattr(L, "LEAF_HELD", 1)
    assert text() == whole and whole != dict(rows)


def test_copies_are_left_to_the_join(spark):
    """Copies keep what they alone share; a notice that other documents share goes from copies as well."""
    own = lambda k: "\n".join(" ".join(f"{c}{chr(97 + k)}{w}" for w in ("ka", "lo", "mi", "nu")) for c in "abcdefgh")
    notice = "all rights are reserved by us"
    rows = [(1, own(1)), (2, own(1) + "\n" + notice), (3, own(1)), (4, own(4) + "\n" + notice), (5, own(5) + "\n" + notice), (6, own(6))]
    got = {r["doc_id"]: r["text"] for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), spare_copies=True).collect()}
    assert got == {1: own(1), 2: own(1), 3: own(1), 4: own(4) + "\n" + notice, 5: own(5), 6: own(6)}


def test_planted_lines_are_caught(spark, docs):
    """Passages of over 50 words put into other documents go from all but one; nothing else changes by that."""
    from pyspark.sql import Window

    before = {r["doc_id"]: r["text"] for r in L.drop_lines(docs).collect()}
    planted = [" ".join(f"plant{k}word{chr(97 + i % 26)}{chr(97 + i // 26)}".replace(str(k), "x" * (k + 1)) for i in range(55)) for k in range(3)]
    ids = sorted(d for d, t in before.items() if t and len(t.split()) > 30)[5:65]
    at = {d: planted[i % 3] for i, d in enumerate(ids)}
    more = spark.createDataFrame(list(at.items()), "doc_id long, extra string")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    df = docs.join(more, "doc_id", "left").withColumn("k", first).withColumn("text", F.when(F.col("extra").isNotNull() & (F.col("k") == 1), F.concat_ws("\n", "text", "extra")).otherwise(F.col("text")))
    after = {r["doc_id"]: r["text"] for r in L.drop_lines(df.select("doc_id", "text")).collect()}
    left = [d for d in ids if at[d] in after[d]]
    assert len(left) == 3 and {at[d] for d in left} == set(planted)
    assert all(after[d].replace("\n" + at[d], "") == before[d] for d in ids) and all(after[d] == t for d, t in before.items() if d not in at)


def test_hot_keys_join_whole(spark):
    from maskwright.llm.shared import salted_join

    rows = spark.range(6000).selectExpr("id", "CASE WHEN id < 5000 THEN 1 ELSE id END AS k")
    table = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = salted_join(rows, table, "k", rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "id")
    assert out.count() == 6000 and out.filter("v <> 2 * k").count() == 0 and set(out.columns) == {"k", "id", "v"}


# ---- registry and pipeline


def test_registry():
    assert {re.match(r"op(\d+)_", k)[1] for k in queries()} == {str(i) for i in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality_rules(spark, docs, SF)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in Q.op4_quality_rules(spark, SF).filter("kept").collect()}
    lines = P.line_dedup(spark, kept, SF)
    assert lines.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(r["n_chars"] == len(r["text"]) and r["text"].split() for r in lines.select("text", "n_chars").collect())
    # copies come through to the join, which finds as many as without the line stage, or nearly
    most = lambda t: len(t) - len(set(groups({d: shingles(x) for d, x in t.items()}).values()))
    alone = most({r["doc_id"]: texts[r["doc_id"]] for r in kept.select("doc_id").collect()})
    assert alone > 10 and most(rows) >= 0.9 * alone
    left = {r["doc_id"] for r in P.jaccard_join(spark, docs, SF).collect()}
    assert left == set(groups({d: shingles(t) for d, t in texts.items()}).values())
    clean = P.decontamination(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() < len(texts)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, stage):
    import corpus_pipeline as P

    name, run = P.STAGES[stage]
    out = run(spark, odd, SF)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids == {0: {6, None}, 1: {4, 5, 6, 7, 8, None}, 2: {1, 2, 3, 4, 5, 6, 7, 8, None}, 3: {1, 2, 3, 4, 5, 6, 7, 8, None}, 4: {1, 2, 3, 4, 5, 6, 7, 8, None}}[stage]
    assert stage == 4 or out.columns == odd.columns
    assert run(spark, odd.limit(0), SF).count() == 0


def test_pipeline_runs(spark, library, monkeypatch):
    """Every id of the last stage's input comes out of the packer once, and no emptied text is among them."""
    import corpus_pipeline as P
    from maskwright.llm.shared import shared_root

    tables = lambda: set(Path(shared_root(spark).removeprefix("file://")).glob("maskwright/stage-*"))
    before, written, kept = tables(), P.staged, []
    monkeypatch.setattr(P, "staged", lambda df, name: kept.append(written(df, name)) or kept.append(kept[-1].select("doc_id", "text").collect()) or kept[-2])
    pieces = P.run(spark, SF).collect()
    assert tables() == before and len(kept) == 2 * (len(P.STAGES) - 1)
    want = {r["doc_id"]: ids_of(library, r["text"]) + [1] for r in kept[-1]}
    assert {p["doc_id"] for p in pieces} == set(want) and all(len(v) > 1 for v in want.values())
    check_pieces(pieces, want)
