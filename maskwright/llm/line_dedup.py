"""Line deduplication by a log-template tree.

Lines are parsed as log messages, with A-Z in lower case: tokens that hold a digit, an at sign or
``://`` are variable fields; a line of such fields alone is taken as it is spelled. The tree has a fixed
depth: a line goes down by its number of tokens, then by its leading ``DEPTH`` tokens, to a leaf. The
depth doesn't depend on the input's size; only a caller who gives ``leaf_most`` has bigger leaves go one
token deeper, until none is so big. In a leaf, lines that agree in ``SIMILAR`` of their places become one template whose other places are variable too. A
template found in enough documents recurs, and recurring templates are dropped from all documents but
the first (``keep_first``), so what many documents share stays in the corpus once.

Lines that are equal after masking are one template without any comparison; only leaves that hold
different lines compare them, in the order of their hashes, so the result doesn't depend on how the
input is dealt out. A leaf is streamed: a task holds the leaf's templates, not its lines, and finds the
templates that a line can join by blocks of places, one of which must agree in full. So lines that no
chain of shared blocks connects can't meet in a template, and a leaf of more than ``LEAF_HELD`` different
lines is dealt over tasks by these chains, which changes no result.

With ``spare_copies`` documents whose words lie to ``COPY_SHARE`` or more in recurring lines are copies,
a case for a join of near copies: they don't count as documents that share a line. What copies alone share
stays whole in them; what other documents share goes from copies, too.

Documents are told apart by id and text. Defined results: null and empty texts have no lines and
stay as they are, as do lines without a token. Repeated rows (same id, same text) are one document and
are edited alike. Rows with null ids are told apart by their texts; of documents that share a template
null ids come first, then the least id. A text all of whose lines go becomes empty; its row stays. An
empty table gives an empty result. Extra columns stay as they are; helper columns have the prefix
``__l_``. Whole texts are parsed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import KeyFilter, drop_staged, read_table, salted_join, staged
from .shingles import PART, mix, range_hashes, split_words
from .tokens import batches_of, slices

DEPTH = 3
SIMILAR = 0.8
#: Different lines of a leaf beyond which it is dealt over tasks; results don't depend on it.
LEAF_HELD = 20_000
#: Documents in which a template of equal lines, and one with generalised places, recurs.
MIN_DOCS, MIN_DOCS_GENERAL = 2, 3
#: Share of a document's words in recurring lines from which it is a copy.
COPY_SHARE = 0.5

#: The hash of a variable field, and a multiplier for the tree's levels.
FIELD = np.uint64(0x632BE59BD9B4E019)
_LEVEL = np.uint64(0x9FB21C651E98DF25)
_VARIABLE = np.zeros(256, bool)
_VARIABLE[[*range(48, 58), ord("@")]] = True


@dataclass
class Lines:
    """Parsed lines of a text that have tokens: place, hash of the masked line, leaf, and the slice
    ``start:end`` of ``tokens`` (hashes, variable ones masked)."""

    place: np.ndarray
    line: np.ndarray
    leaf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    tokens: np.ndarray


def _parts(codes: np.ndarray) -> list[np.ndarray]:
    """The text in runs of whole lines of about ``PART`` bytes."""
    out, at = [], 0
    while len(codes) - at > PART:
        ends = np.flatnonzero(codes[at + PART :] == 10)
        if not len(ends):
            break
        out.append(codes[at : at + PART + int(ends[0]) + 1])
        at += PART + int(ends[0]) + 1
    return [*out, codes[at:]]


def parse(text: str | None, depth: int = DEPTH) -> Lines:
    """The lines of one text."""
    return parse_many([text], depth)[1]


def parse_many(texts: list[str | None], depth: int = DEPTH) -> tuple[np.ndarray, Lines]:
    """The lines of many texts, parsed as one: the number of each line's text, and the lines, whose
    places count from the start of their own text."""
    raw = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    first = np.cumsum([0, *(x.count(b"\n") + 1 for x in raw)])
    found = _parse(np.frombuffer(b"\n".join(raw), np.uint8), depth)
    own = np.searchsorted(first, found.place, "right") - 1
    found.place = found.place - first[own]
    return own, found


def _parse(codes: np.ndarray, depth: int) -> Lines:
    found, lines, tokens = [], 0, 0
    for part in _parts(codes):
        h, starts, ends = split_words(part)
        breaks = np.flatnonzero(part == 10)
        if len(h):
            seen = np.zeros(len(part) + 1, np.int64)
            np.cumsum(_VARIABLE[part], out=seen[1:])
            variable = seen[ends] > seen[starts]
            links = np.flatnonzero((part[:-2] == 58) & (part[1:-1] == 47) & (part[2:] == 47))
            inside = np.searchsorted(starts, links, "right") - 1
            variable[inside[links + 2 < ends[inside]]] = True
            row = np.searchsorted(breaks, starts)
            s = np.flatnonzero(np.diff(row, prepend=-1))
            e = np.append(s[1:], len(h))
            fields = np.add.reduceat(variable.astype(np.int64), s)
            h = np.where(variable & np.repeat(fields < e - s, e - s), FIELD, h)
            level = np.zeros(len(s), np.uint64)
            for k in range(depth):
                level = mix(level * _LEVEL + np.where(e - s > k, h[np.minimum(s + k, len(h) - 1)], np.uint64(k)))
            n = (e - s).astype(np.uint64)
            found.append((row[s] + lines, mix(range_hashes(mix(h), s, e)), mix(level * _LEVEL + n), s + tokens, e + tokens, h))
            tokens += len(h)
        lines += len(breaks)
    if not found:
        none = np.empty(0, np.int64)
        return Lines(none, none.view(np.uint64), none.view(np.uint64), none, none, none.view(np.uint64))
    return Lines(*(np.concatenate(x) for x in zip(*found, strict=True)))


def places(n: int, similar: float = SIMILAR) -> int:
    """Places in which a line of n tokens must agree with its template."""
    return int(np.ceil(similar * n - 1e-9))


def blocks(row: np.ndarray, similar: float, lead: int = 0) -> list[tuple[int, bytes]]:
    """The places of a line after the first ``lead`` in one block more than a line may differ in from its
    template: the block's start and what it holds."""
    cuts = np.linspace(min(lead, len(row)), len(row), len(row) - places(len(row), similar) + 2).astype(int)
    return [(int(a), row[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Leaf:
    """Templates of one leaf, grown line by line.

    A line that joins a template differs from it in few places, so if the places are cut into one block
    more, one block agrees in full. Templates are kept by their blocks; one that became variable in a
    block can't agree there and is met by another.
    """

    def __init__(self, similar: float, lead: int = 0):
        self.similar, self.lead = similar, lead  # the leading places agree in all lines of a leaf
        self.rows: list[np.ndarray] = []
        self.ids: list[int] = []
        self.by_block: dict[tuple[int, bytes], list[int]] = {}

    def add(self, key: int, row: np.ndarray) -> int:
        """The template that takes the line in: the most alike, the oldest of equals."""
        least = places(len(row), self.similar)
        own = blocks(row, self.similar, self.lead)
        near = sorted({k for x in own for k in self.by_block.get(x, ())})
        if near:
            same = (np.stack([self.rows[k] for k in near]) == row).sum(axis=1)
            at = int(same.argmax())
            if same[at] >= least:
                found = self.rows[near[at]]
                found[found != row] = 0  # no token's place any more
                return self.ids[near[at]]
        for x in own:
            self.by_block.setdefault(x, []).append(len(self.rows))
        self.rows.append(row.copy())
        self.ids.append(key)
        return key


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """Each line with a token: document, place, hash of the masked line, leaf, tokens."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(2).to_pylist()
                for run_of in batches_of(texts):
                    doc, x = parse_many(texts[run_of], depth)
                    own = pa.array(doc + run_of.start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(own), part.column(1).take(own), pa.array(x.place.astype(np.int32)), pa.array(x.line.view(np.int64)), pa.array(x.leaf.view(np.int64)), pa.array((x.end - x.start).astype(np.int32))],
                        names=["key", "doc_id", "place", "line", "leaf", "tokens"],
                    )

    return docs.mapInArrow(run, "key long, doc_id long, place int, line long, leaf long, tokens int")


def _templates(docs: DataFrame, kinds: DataFrame, depth: int, similar: float, leaf_most: int | None) -> DataFrame:
    """(line, template) of lines in leaves that hold different lines."""
    alike = kinds.filter(F.col("tokens") > F.ceil(F.lit(similar) * F.col("tokens") - 1e-9))
    shared = alike.groupBy("leaf").count().filter("count > 1").select("leaf")
    wanted = staged(alike.join(shared, "leaf", "left_semi").select("line"), "leaf-lines")
    allowed = KeyFilter(wanted, "line")

    def tokens(batches):
        test, seen = allowed.tester(), set()
        for batch in batches:
            for part in slices(batch):
                out = []
                texts = part.column(2).to_pylist()
                for run_of in batches_of(texts):
                    x = parse_many(texts[run_of], depth)[1]
                    for k in np.flatnonzero(test(x.line.view(np.int64))).tolist():
                        if (key := int(x.line[k])) not in seen:
                            seen.add(key)
                            out.append((x.line[k].view(np.int64), x.leaf[k].view(np.int64), x.tokens[x.start[k] : x.end[k]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["line", "leaf", "tokens"])

    found = staged(docs.mapInArrow(tokens, "line long, leaf long, tokens binary").join(wanted, "line", "left_semi").dropDuplicates(["line"]), "leaf-tokens")
    deeper = depth
    while leaf_most and (big := _big_leaves(found, leaf_most, deeper)):
        down = F.xxhash64("leaf", F.substring("tokens", 8 * deeper + 1, 8))
        split = found.join(big, "leaf", "left").withColumn("leaf", F.when(F.col("big"), down).otherwise(F.col("leaf"))).select(found.columns)
        split, before = staged(split, "leaf-tokens"), found
        drop_staged(before)
        found, deeper = split, deeper + 1
    found = _dealt(found, depth, similar)

    def grow(batches):
        leaf, held = None, Leaf(similar, depth)
        for batch in batches:
            keys, leaves, rows = (batch.column(i).to_pylist() for i in range(3))
            own = []
            for k, where, row in zip(keys, leaves, rows, strict=True):
                if where != leaf:
                    leaf, held = where, Leaf(similar, depth)
                own.append(held.add(k, np.frombuffer(row, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64())], names=["line", "template"])

    grown = staged(found.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(grow, "line long, template long"), "templates")
    drop_staged(wanted, found)
    return grown


def _dealt(found: DataFrame, depth: int, similar: float) -> DataFrame:
    """Lines whose leaf holds more than ``LEAF_HELD`` get a leaf of their own with those that chains of shared
    blocks connect them to. A line shares a block with the first line of its template, so no template is cut."""
    big = found.groupBy("leaf").count().filter(F.col("count") > LEAF_HELD).select("leaf", F.lit(True).alias("big"))
    if not big.limit(1).count():
        return found

    def cut(batches):
        for batch in batches:
            lines, keys = [], []
            for line, leaf, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for start, words in blocks(np.frombuffer(row, np.uint64), similar, depth):
                    lines.append(line)
                    keys.append(int.from_bytes(hashlib.blake2b(b"%d %d %d " % (leaf, len(row), start) + words, digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(keys, pa.int64())], names=["line", "block"])

    held = found.join(F.broadcast(big), "leaf", "left")  # fewer than a row for each LEAF_HELD lines
    shared = staged(held.filter("big").select("line", "leaf", "tokens").mapInArrow(cut, "line long, block long"), "blocks")
    first = shared.groupBy("block").agg(F.min("line").alias("a"), F.max("line").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z")
    counts = staged(first, "first")
    links = salted_join(shared, counts.select("block", "a"), "block", counts.select("block", "n"), "line").filter("a <> line").select("a", F.col("line").alias("b"))
    part = components(links).withColumnRenamed("node", "line")
    leaf = F.when(F.col("big"), F.xxhash64("leaf", F.coalesce("comp", "line"))).otherwise(F.col("leaf"))
    out = staged(held.join(part, "line", "left").withColumn("leaf", leaf).select(found.columns), "leaf-tokens")
    drop_staged(found, shared, counts)
    return out


def _big_leaves(found: DataFrame, leaf_most: int, deeper: int) -> DataFrame | None:
    """Leaves of too many lines that have a token at place ``deeper``; none is None. A table of lines
    holds few leaves so big, one for each ``leaf_most`` lines at most."""
    big = found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("tokens")).alias("bytes")).filter((F.col("n") > leaf_most) & (F.col("bytes") > 8 * deeper))
    return big.select("leaf", F.lit(True).alias("big")) if big.limit(1).count() else None


def _recurring(by_doc: DataFrame, min_docs: int, min_docs_general: int) -> DataFrame:
    """Templates of enough documents, with their first document and how many rows they have there."""
    counted = by_doc.groupBy("template").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "key")).alias("first"), (F.min("lo") < F.max("hi")).alias("general"), F.sum("n").alias("n")
    )
    return counted.filter(F.when(F.col("general"), F.col("docs") >= min_docs_general).otherwise(F.col("docs") >= min_docs))


def recurring_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, min_docs_general: int = MIN_DOCS_GENERAL,
    keep_first: bool = True, spare_copies: bool = False, leaf_most: int | None = None,
) -> DataFrame:
    """(key, places): for each document with lines to drop, their places in ascending order. ``key``
    is xxhash64 of id and text."""
    docs = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = staged(_lines(docs, depth), "lines")
    kinds = staged(lines.groupBy("leaf", "line").agg(F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "kinds")
    grown = _templates(docs, kinds, depth, similar, leaf_most)
    template_of = kinds.join(grown, "line", "left").select("line", F.coalesce("template", "line").alias("template"))
    named = staged(salted_join(lines.drop("leaf"), template_of, "line", kinds.select("line", "n"), "key", "place"), "named")
    drop_staged(lines, kinds, grown)
    # one row for a template and document, so that counts are of documents; sums are partial first
    by_doc = named.groupBy("template", "key", "doc_id").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count(F.lit(1)).alias("n"))
    recurring = staged(_recurring(by_doc, min_docs, min_docs_general), "recurring")
    gone = [named, recurring]
    counts = recurring.select("template", "n")
    if spare_copies:
        shared = salted_join(named.select("template", "key", "place", "tokens"), recurring.select("template"), "template", counts, "key", "place")
        weight = named.groupBy("key").agg(F.sum("tokens").alias("all")).join(shared.groupBy("key").agg(F.sum("tokens").alias("shared")), "key")
        copies = weight.filter(F.col("shared") >= COPY_SHARE * F.col("all")).select("key")
        recurring = staged(_recurring(by_doc.join(copies, "key", "left_anti"), min_docs, min_docs_general), "recurring")
        gone.append(recurring)
    drops = salted_join(named.select("template", "key", "place"), recurring.select("template", F.col("first.key").alias("first")), "template", counts, "key", "place")
    if keep_first:
        drops = drops.filter("key <> first")
    out = staged(drops.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places")), "drops")
    drop_staged(*gone)
    return out


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """``df`` with recurring lines taken out of its texts and all else as it was; ``counts`` adds
    ``n_lines`` and ``n_dropped``."""
    drops = recurring_lines(df, id_col, text_col, **options).withColumnRenamed("key", "__l_key").withColumnRenamed("places", "__l_places")
    wide = df.withColumn("__l_key", F.xxhash64(F.col(id_col), F.col(text_col))).join(drops.hint("shuffle_merge"), "__l_key", "left")
    columns = [c for c in df.columns if not (counts and c in ("n_lines", "n_dropped"))]
    schema = df.select(*[F.col(f"`{c}`") for c in columns], *([F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")] if counts else [])).schema
    wide = wide.select(*[F.col(f"`{c}`") for c in columns], "__l_places")
    at = columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out, lines, dropped = [], [], []
                for text, gone in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist(), strict=True):
                    if counts:
                        lines.append(text.count("\n") + 1 if text else 0)
                        dropped.append(len(gone or ()))
                    if gone:
                        gone = set(gone)
                        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                    out.append(text)
                arrays = [pa.array(out, part.schema.field(at).type) if i == at else part.column(i) for i in range(len(columns))]
                arrays += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return wide.mapInArrow(run, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that recur across documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, counts=True)
