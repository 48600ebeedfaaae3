"""N-gram Jaccard self-join: size-aware, heavy and light sets apart.

Documents with one and the same shingle set are one *set*. All sets share a global order of
shingles: by hash, with the most frequent ones last. If two sets of sizes n and m have Jaccard
similarity of at least t, they share ceil(t * max(n, m)) shingles, so their first
n - ceil(t * n) + k and m - ceil(t * m) + k shingles have at least k in common. Hence:

* light sets (fewer than ``boundary`` shingles) enumerate all 2-subsets of that prefix for k = 2;
  two light sets that link share a subset;
* heavy sets put that prefix for k = 1 into inverted lists and are met there by all sets of a
  size that can link with theirs, light ones too.

The boundary is the one of least estimated cost, from the sizes of all sets and the exact load of
the lists. Lists are streamed in sorted order; no list is ever gathered. A candidate must pass an
upper bound of its overlap, from bitmaps of both sets, and is then verified on whole sets. In rounds, each set is held against the few sets
that head most of its lists, and links join components; then only pairs of one list that lie in different components are left, and all of those are verified, so no link between components is lost and a group of near
copies never becomes all its pairs.

The frequent shingles' table is bounded by ``HOT_MOST``; which shingles it holds changes the order
(any order is right) and so the cost, never the result.

Defined results: null, empty and all-space texts have the empty set, link with nothing and are
their own component. Texts of fewer than five words have one shingle, the whole sequence. Repeated rows
and copies are one set: each input row gives one row. A null id counts in no minimum; a
component of null ids alone has a null id. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import KeyFilter, drop_staged, read_table, release_shuffles, salted_join, small_batches, staged
from .shingles import mix, set_key, shingle_set
from .tokens import slices

THRESHOLD = (75, 100)
#: Sizes up to which a boundary between light and heavy sets is considered.
MOST_LIGHT = 256
#: A shingle in so many sets (as far as chunks have seen it more than once) is frequent; so many are kept.
HOT_LEAST, HOT_MOST = 6, 200_000
#: Rounds of stars, and heads that a set is held against in each.
ROUNDS, STARS = 3, 8
#: Lists looked back at, so that sets with many lists in common don't make a pair in each.
BEFORE = 6
#: Keys of sets that are broadcast, at most (8 MB).
KEYS_MOST = 1 << 20
#: Shingles counted at once by a worker.
CHUNK = 2_000_000

_PAIR_DOMAIN = np.uint64(0xD1B54A32D192ED03)


def needed(n: int, t: tuple[int, int] = THRESHOLD) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-t[0] * n // t[1])


def prefix(n: int, k: int, t: tuple[int, int] = THRESHOLD) -> int:
    return min(n, n - needed(n, t) + k)


def choose_boundary(sizes: dict[int, int], load: float, t: tuple[int, int] = THRESHOLD) -> int:
    """The boundary of least cost: subsets that light sets enumerate, against entries of the lists
    and the other entries (``load`` for each) that a scan meets there."""
    best, at = math.inf, 2
    for b in range(2, MOST_LIGHT + 1):
        light = sum(c * math.comb(prefix(n, 2, t), 2) for n, c in sizes.items() if n < b)
        heavy = sum(c * prefix(n, 1, t) for n, c in sizes.items() if n * t[1] >= b * t[0])
        if (cost := light + heavy * (1 + load)) < best:
            best, at = cost, b
    return at


def _survey(docs: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The only pass over the texts. kind 0: shingle and how often a chunk has it; 1: set size and sets;
    2: entries of prefixes; 3: a document, its set and, where the partition has the set for the first
    time, the set's sketch and its shingles in ascending order."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        sizes: dict[int, int] = {}
        entries = waiting = 0

        def chunk():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            hot = counts >= 3
            held.clear()
            return _rows([0] * int(hot.sum()), values[hot].view(np.int64), counts[hot])

        for batch in batches:
            for part in slices(batch):
                keys, ns, sketches, sets = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text)
                    ns.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sketches.append(None)
                    sets.append(None)
                    if len(s) and keys[-1] not in seen:
                        seen.add(keys[-1])
                        sketches[-1], sets[-1] = sketch(s), s.view(np.int64)
                        sizes[min(len(s), MOST_LIGHT * 2)] = sizes.get(min(len(s), MOST_LIGHT * 2), 0) + 1
                        held.append(s)
                        entries += prefix(len(s), 1, t)
                        waiting += len(s)
                        if waiting >= CHUNK:
                            yield chunk()
                            waiting = 0
                yield _rows([3] * len(ns), keys, ns, part.column(0), sketches, part.column(2), sets)
        if held:
            yield chunk()
        yield _rows([1] * len(sizes) + [2], [*sizes, entries], [*sizes.values(), 0])

    return docs.mapInArrow(run, "kind int, key long, n long, doc_id long, sketch binary, row_key long, shingles array<long>")


def _rows(kinds, keys, ns, ids=None, sketches=None, rows=None, sets=None) -> pa.RecordBatch:
    none = [None] * len(kinds)
    columns = zip((kinds, keys, ns, *(none if c is None else c for c in (ids, sketches, rows, sets))), (pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in columns], names=["kind", "key", "n", "doc_id", "sketch", "row_key", "shingles"])


def _sets_of(survey: DataFrame) -> DataFrame:
    """(key, shingles) of all sets; a set that several partitions have comes once from each."""
    return survey.filter("shingles IS NOT NULL").select("key", "shingles")


def _each(batches):
    """Keys and sets of the rows, in runs."""
    for batch in batches:
        for part in slices(batch):
            sets = part.column(1)
            ends = sets.offsets.to_numpy()
            flat = sets.values.to_numpy().view(np.uint64)
            yield part.column(0).to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of the set with about four bits for each shingle."""
    m = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(shingles & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """At least as many as two sets share: common bits, and shingles beyond the first of a bit."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    count = lambda v: int(np.bitwise_count(v).sum())
    return count(a & b) + min(nx - count(a), ny - count(b))


def ordered(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Shingles in the global order: by hash, frequent ones last."""
    if not len(hot):
        return shingles
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    last = hot[at] == shingles
    return np.concatenate([shingles[~last], shingles[last]])


def signatures(shingles: np.ndarray, hot: np.ndarray, boundary: int, t: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists and subsets under which a set is looked up, and the shingle's place in the
    set's order (for subsets, one less than the later shingle's: one shared shingle lies before it)."""
    n = len(shingles)
    row = ordered(shingles, hot)
    out, at = [], []
    if n * t[1] >= boundary * t[0]:
        out.append(row[: prefix(n, 1, t)])
        at.append(np.arange(len(out[-1])))
    if 2 <= n < boundary:
        pairs = np.array(list(combinations(row[: prefix(n, 2, t)].tolist(), 2)), np.uint64)
        out.append(mix(mix(pairs[:, 0]) * _PAIR_DOMAIN + pairs[:, 1]))
        at.append(np.array([j - 1 for _, j in combinations(range(prefix(n, 2, t)), 2)], np.int64))
    return (np.concatenate(out), np.concatenate(at)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _entries(survey: DataFrame, hot: np.ndarray, t: tuple[int, int]) -> DataFrame:
    """(key): the shingles of all prefixes, one row for each entry that a list would have."""

    def run(batches):
        for _, sets in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([signatures(s, hot, 0, t)[0] for s in sets]).view(np.int64))], names=["key"])

    return _sets_of(survey).mapInArrow(run, "key long")


def _postings(survey: DataFrame, hot: np.ndarray, boundary: int, t: tuple[int, int]) -> DataFrame:
    def run(batches):
        for keys, sets in _each(batches):
            found, places = zip(*(signatures(s, hot, boundary, t) for s in sets), strict=True)
            lengths = [len(x) for x in found]
            sizes = np.concatenate(places) + (np.repeat([len(s) for s in sets], lengths) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(sizes)], names=["token", "key", "size_place"])

    return _sets_of(survey).mapInArrow(run, "token long, key long, size_place long")


def _may_link(x: str, y: str, t: tuple[int, int]) -> str:
    """SQL that is false if the sizes of two entries rule a link out, or their list can't be the first
    that both sets share: from it on, too few shingles are left in one of them."""
    return (
        f"least({x}.n, {y}.n) * {t[1]} >= greatest({x}.n, {y}.n) * {t[0]}"
        f" AND {sum(t)} * least({x}.n - {x}.place, {y}.n - {y}.place) >= {t[0]} * ({x}.n + {y}.n)"
    )


def _lists(postings: DataFrame) -> DataFrame:
    """Entries of lists with at least two sets: token, key, size n and place. Sorted rows are
    streamed; memory is one entry."""

    def run(batches):
        token = key = head = None
        for batch in batches:
            toks, keys, sizes = (batch.column(i).to_numpy() for i in range(3))
            fresh = np.ones(len(toks), bool)
            fresh[1:] = toks[1:] != toks[:-1]
            lone = fresh.copy()
            lone[:-1] &= fresh[1:]
            lone[0] &= token is None or toks[0] != token
            lone[-1] = False  # its list may go on in the next batch
            out = []
            at = np.flatnonzero(~lone)
            for tok, k, n, place in zip(toks[at].tolist(), keys[at].tolist(), (sizes[at] >> 32).tolist(), (sizes[at] & 0xFFFFFFFF).tolist(), strict=True):
                if tok != token:
                    token, head = tok, (tok, k, n, place)
                elif k != key:
                    if head:
                        out.append(head)
                        head = None
                    out.append((tok, k, n, place))
                key = k
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["token", "key", "n", "place"])

    return postings.repartition("token").sortWithinPartitions("token", "size_place", "key").mapInArrow(run, "token long, key long, n int, place int")


def _wanted(survey: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shingles) of the sets named by ``keys``, once each.

    As long as the keys are few (``KEYS_MOST``) they go to every executor, and the other sets never leave
    theirs; beyond that a bitmap of bounded size keeps most of the others from the join's shuffle.
    """
    sets = _sets_of(survey)
    if keys.count() <= KEYS_MOST:
        return sets.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"])
    wanted = KeyFilter(keys, "key")

    def run(batches):
        test = wanted.tester()
        for batch in batches:
            for part in slices(batch, 64):
                yield part.filter(pa.array(test(part.column(0).to_numpy())))

    return sets.mapInArrow(run, "key long, shingles array<long>").join(keys, "key", "left_semi").dropDuplicates(["key"])


def _possible(pairs: DataFrame, survey: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link, as (left, right)."""
    sketches = survey.filter("kind = 3 AND sketch IS NOT NULL").select("key", "n", "sketch").dropDuplicates(["key"])
    one = sketches.toDF("a", "na", "x")
    two = sketches.toDF("b", "nb", "y")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2048):
                na, x, nb, y = (part.column(i).to_pylist() for i in range(2, 6))
                keep = [t[1] * (o := overlap_bound(x[i], na[i], y[i], nb[i])) >= t[0] * (na[i] + nb[i] - o) for i in range(part.num_rows)]
                found = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["left", "right"])

    wide = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "x", "nb", "y")
    return wide.mapInArrow(run, "left long, right long")


def _verified(pairs: DataFrame, survey: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link, by whole sets; staged."""
    pairs = staged(_possible(pairs, survey, t), "possible")
    keys = staged(pairs.select(F.col("left").alias("key")).union(pairs.select("right")).distinct(), "keys")
    sets = staged(_wanted(survey, keys), "sets")
    x, y = (sets.toDF(side, c) for side, c in (("left", "x"), ("right", "y")))
    both = F.size(F.array_intersect("x", "y"))
    linked = F.lit(t[1]) * both >= F.lit(t[0]) * (F.size("x") + F.size("y") - both)
    out = staged(pairs.join(y, "right").join(x, "left").filter(linked).select(F.col("left").alias("a"), F.col("right").alias("b")), "verified")
    drop_staged(pairs, keys, sets)
    return out


def _stars(live: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of each set with the ``STARS`` heads that it shares most lists with. The head of a
    list is its set of least hash: the same for all lists at first, so that groups gather, and then
    one of each list's own, another in each round."""
    order = F.xxhash64("key", F.lit(k), *(["token"] if k else []))
    heads = live.groupBy("token").agg(F.min(F.struct(order, "comp", "key", "n", "place")).alias("y"), F.count(F.lit(1)).alias("rows"))
    both = salted_join(live, heads.select("token", "y"), "token", heads.select("token", F.col("rows").alias("n")), "key").selectExpr("struct(*) AS x", "y")
    shared = both.filter(f"x.comp <> y.comp AND {_may_link('x', 'y', t)}").groupBy(F.col("x.key").alias("key"), F.col("y.key").alias("head")).count()
    # a set has no more heads than entries, so its list is bounded by its own prefix
    best = shared.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "head")), False), 1, STARS).alias("best"))
    pairs = best.select("key", F.explode("best.head").alias("head"))
    return pairs.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after more links; only components that links join are worked on."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if comps is None:
        comps = nodes.select("node", F.col("node").alias("comp"))
    else:
        comps = comps.unionByName(nodes.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    comps = staged(comps, "comps")
    a, b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    joined = links.join(a, "a").join(b, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    higher = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    out = staged(comps.join(higher, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp")), "comps")
    drop_staged(comps)
    return out


def _live(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Entries, with components, of lists that hold more than one component; staged."""
    if comps is None:
        return staged(lists.withColumn("comp", F.col("key")), "live")
    where = lists.join(comps.withColumnRenamed("node", "key"), "key", "left").select("token", "key", "n", "place", F.coalesce("comp", "key").alias("comp"))
    mixed = where.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return staged(where.join(mixed, "token", "left_semi"), "live")


def _apart(live: DataFrame, t: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) of sets of one list and different components that may link.

    The places of two linked sets' first shared shingles are bounded, so that both prefixes hold the
    first ``K`` of them: with n - ceil(t n) + 1 shingles in a prefix and an overlap o, the k-th shared
    one stands at n - o + k at the latest. Hence the sets meet in K lists; a bitmap of each set's
    lists bounds how many they have in common. A pair is left to an earlier list where both sets come
    from one of their last ``BEFORE`` lists together; in the first list that they share they can't,
    so each pair comes out there at least.
    """
    word = F.pmod(F.shiftright("token", 6), F.lit(4))
    marks = [F.bit_or(F.when(word == j, F.expr("shiftleft(1L, cast(pmod(token, 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(4)]
    maps = live.groupBy("key").agg(*marks, F.count(F.lit(1)).alias("lists"))
    maps = maps.withColumn("spare", F.col("lists") - sum((F.bit_count(f"w{j}") for j in range(1, 4)), F.bit_count("w0")))
    own = Window.partitionBy("key").orderBy("place", "token")
    entries = live.withColumn("before", F.array(*[F.lag("token", i).over(own) for i in range(1, BEFORE + 1)])).join(maps, "key")
    up = lambda part, whole: f"(({part}) + {whole} - 1) div {whole}"
    k = f"1 - {up(f'{t[0]} * greatest(x.n, y.n)', t[1])} + {up(f'{t[0]} * (x.n + y.n)', sum(t))}"
    common = " + ".join(f"bit_count(x.w{j} & y.w{j})" for j in range(4)) + " + least(x.spare, y.spare)"
    apart = F.expr(f"x.token = y.token AND x.comp < y.comp AND {_may_link('x', 'y', t)} AND {common} >= {k} AND NOT coalesce(arrays_overlap(x.before, y.before), false)")
    pairs = entries.alias("x").join(entries.alias("y"), apart)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _frequent(counts: DataFrame) -> np.ndarray:
    """The HOT_MOST most frequent of (key, c), ascending."""
    top = counts.filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "key").limit(HOT_MOST)
    return np.sort(np.array([r["key"] for r in top.collect()], np.int64).view(np.uint64))


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id, boundary, row_key, stays) for each row of ``df``.

    ``row_key`` is xxhash64 of id and text; ``stays`` is true for one row key of each component, that
    of the least id (null ids last), and for all rows without words.
    """
    with small_batches(df.sparkSession):
        return _linked(df, id_col, text_col, t)


def _linked(df: DataFrame, id_col: str, text_col: str, t: tuple[int, int]) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = staged(_survey(docs.withColumn("row_key", F.xxhash64("doc_id", "text")), t), "survey")
    sizes = {r["key"]: r["c"] for r in survey.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("c")).collect()}
    entries = survey.filter("kind = 2").agg(F.coalesce(F.sum("key"), F.lit(0))).first()[0]
    # frequent shingles: as chunks saw them, then by the exact length of their lists
    seen = survey.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("c"))
    counts = _entries(survey, _frequent(seen), t).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    exact = staged(counts.filter("c > 1"), "exact")
    hot = _frequent(seen.unionByName(exact).groupBy("key").agg(F.max("c").alias("c")))
    # what a list's entry will meet on average, once the frequent shingles are last
    met = exact.filter(F.col("c") < HOT_LEAST).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1)), F.lit(0))).first()[0]
    boundary = choose_boundary(sizes, met / max(1, entries), t)
    drop_staged(exact)
    release_shuffles(df.sparkSession)
    lists = staged(_lists(_postings(survey, hot, boundary, t)), "lists")
    release_shuffles(df.sparkSession)

    tested = comps = None
    for k in range(ROUNDS):
        live = _live(lists, comps)
        stars = _stars(live, k, t)
        stars = staged(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), "stars")
        links = _verified(stars, survey, t)
        tested = stars if tested is None else tested.unionByName(stars)
        drop_staged(live)
        release_shuffles(df.sparkSession)
        if not links.limit(1).count():
            break
        comps = _merged(comps, links)
    # what is left: all pairs of one list that no chain of links joins yet
    live = _live(lists, comps)
    pairs = _apart(live, t)
    last = _verified(pairs.join(tested, ["a", "b"], "left_anti"), survey, t)
    comps = _merged(comps, last)

    classed = (
        survey.filter("kind = 3").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), "row_key")
        .join(comps.withColumnRenamed("node", "set_key"), "set_key", "left")
        .withColumn("comp", F.coalesce("comp", "set_key"))
    )
    least = classed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    drop_staged(live, lists)
    return classed.join(least, "comp", "left").select(
        "doc_id", "n_shingles", "set_key", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.lit(boundary).alias("boundary"),
        "row_key", (F.col("comp").isNull() | (F.col("row_key") == F.col("first.row_key"))).alias("stays"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay, all columns kept: of each component the document of least id
    (null ids last), and every row without words. Rows that repeat id and text are one document: of
    those with words, one stays."""
    found = linked(df, id_col, text_col, t).filter("stays").groupBy("row_key").agg(F.max("n_shingles").alias("__j_n")).withColumnRenamed("row_key", "__j_key")
    kept = df.withColumn("__j_key", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))).join(found.hint("shuffle_merge"), "__j_key")
    again = Window.partitionBy("__j_key").orderBy(F.lit(0))
    kept = kept.withColumn("__j_place", F.row_number().over(again)).filter("__j_place = 1 OR __j_n = 0")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of similarity 0.75 or more."""
    return linked(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "boundary")
