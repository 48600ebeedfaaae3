"""Benchmark decontamination by SimHash of item-sized windows.

For a benchmark item of L words, windows of L words of a document are fingerprinted: each shingle
of five words votes on 64 bits with its hash, once for each time it occurs. Items of the same
length lie in eight tables, one for each byte of the fingerprint, under every byte value within
``RADIUS // 8`` bits of their own. Two fingerprints within ``RADIUS`` bits differ in at most that
many bits in one byte at least, so the tables return every item within the radius. What they
return is checked for its distance and then verified exactly: the similarity is the weighted
Jaccard of the bags of shingles (sum of lesser counts over sum of greater counts), 0.75 or more.

Window and item have equally many shingles, so that similarity needs ceil(6/7) of the window's
shingles among the benchmark's. Windows below this can't be verified and aren't fingerprinted; the
condition is necessary, so it loses nothing.

At similarity 0.75 two fingerprints differ in 11 bits on average with a deviation of 3, so a radius
of 22 loses about 2 windows in 10,000 at the very threshold and fewer above; neighbouring windows
give the same passage more chances.

A document shorter than an item is one window, all of it. It may differ from the item in size, so the
least number of its shingles among the benchmark's follows from both sizes; beyond that it is
compared with every item of that length exactly, at any distance.

The benchmark goes out in blocks of ``BLOCK_BYTES`` of its text, so neither the driver nor a worker ever
holds more than one block; the documents are read once for each block, which for any usual benchmark is
once. Documents are never shuffled.

At 0.75 the radius is a third of the bits, so the tables alone can't tell much: of random items of one
length they return about 70 %. What keeps the work small is the bound on known shingles, which few windows
pass.

Defined results: null and empty texts leak nothing; items without words are skipped. An item of
fewer than five words has one shingle, all of it, and matches only its very words. Repeated
documents are each reported, as are repeated items. Rows with null ids are reported with null ids.
Empty tables give empty results. Extra columns stay as they are; the helper column is ``__d_leaks``.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .shingles import SHINGLE, shingle_hashes, word_hashes
from .tokens import slices

THRESHOLD = 0.75
RADIUS = 22
BLOCKS = 8
#: Text of the benchmark that one set of tables holds.
BLOCK_BYTES = 16 << 20
#: Window starts fingerprinted at once.
STARTS = 2048

LEAKS = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` shingles from each start (ascending)."""
    lo = int(starts[0])
    part = shingles[lo : int(starts[-1]) + width]
    votes = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(part) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=total[1:], dtype=np.int32)
    at = starts - lo
    ones = total[at + width] - total[at]
    return np.packbits(2 * ones > width, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    less = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return less / (sum(a.values()) + sum(b.values()) - less)


class Tables:
    """Fingerprints of items of one length, under all bytes near their own."""

    def __init__(self, radius: int, blocks: int = BLOCKS):
        self.radius, self.near = radius, radius // blocks
        self.items: list[tuple[int | None, Counter]] = []
        self.prints: list[int] = []
        self.by_byte: dict[tuple[int, int], list[int]] = defaultdict(list)

    def add(self, item_id, bag: Counter, fingerprint: int) -> None:
        k = len(self.items)
        self.items.append((item_id, bag))
        self.prints.append(fingerprint)
        for b in range(BLOCKS):
            own = fingerprint >> (8 * b) & 255
            for value in range(256):
                if (own ^ value).bit_count() <= self.near:
                    self.by_byte[b, value].append(k)

    def within(self, fingerprint: int) -> list[tuple[int, int]]:
        """(item, distance) of all items within the radius."""
        found = {k for b in range(BLOCKS) for k in self.by_byte.get((b, fingerprint >> (8 * b) & 255), ())}
        return [(k, d) for k in sorted(found) if (d := (self.prints[k] ^ fingerprint).bit_count()) <= self.radius]


class Detector:
    """Tables of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold = threshold
        self.tables: dict[int, Tables] = {}
        known: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text in items:
            hashes = word_hashes(text)
            if not (n := len(hashes)):
                continue
            s = shingle_hashes(hashes)
            known[min(n, SHINGLE)].append(s)
            table = self.tables.setdefault(n, Tables(radius))
            table.add(item_id, Counter(s.tolist()), int(fingerprints(s, np.zeros(1, np.int64), len(s))[0]))
        self.known = {w: np.unique(np.concatenate(v)) for w, v in known.items()}
        self.marks = {}
        for w, v in self.known.items():  # a bitmap answers most look-ups
            self.marks[w] = np.zeros(1 << 20, bool)
            self.marks[w][(v & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item_id, start word, words, distance, similarity) of each leak; spans of one item don't overlap."""
        hashes = word_hashes(text)
        out = []
        for width, known in self.known.items():
            if len(hashes) < width:
                continue
            s = shingle_hashes(hashes, width)
            hits = np.flatnonzero(self.marks[width][(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            hits = hits[known[np.minimum(np.searchsorted(known, s[hits]), len(known) - 1)] == s[hits]]
            if not len(hits):
                continue
            inside = np.zeros(len(s) + 1, np.int64)
            inside[hits + 1] = 1
            inside = np.cumsum(inside)
            for n, table in self.tables.items():
                if min(n, SHINGLE) != width:
                    continue
                if n <= len(hashes):
                    out += self._windows(s, inside, n, n - width + 1, table)
                else:
                    out += self._whole(s, int(inside[-1]), len(hashes), n - width + 1, table)
        return out

    def _whole(self, s, hits: int, n: int, wide: int, table: Tables) -> list:
        """A text shorter than the items, against each of them; without the bound on hits none can be near."""
        if hits < self.threshold / (1 + self.threshold) * (len(s) + wide) - 1e-9:
            return []
        mark = int(fingerprints(s, np.zeros(1, np.int64), len(s))[0])
        bag, out = Counter(s.tolist()), []
        for (item_id, other), own in zip(table.items, table.prints, strict=True):
            if (sim := similarity(bag, other)) >= self.threshold:
                out.append((item_id, 0, n, (own ^ mark).bit_count(), sim))
        return out

    def _windows(self, s, inside, n: int, wide: int, table: Tables) -> list:
        least = math.ceil(2 * self.threshold / (1 + self.threshold) * wide - 1e-9)
        starts = np.flatnonzero(inside[wide:] - inside[:-wide] >= least)
        best: dict[int, list] = defaultdict(list)
        for k in range(0, len(starts), STARTS):
            block = starts[k : k + STARTS]
            # far-apart starts are fingerprinted apart, so a long text costs only its windows
            for run in np.split(block, np.flatnonzero(np.diff(block) > wide) + 1):
                for start, mark in zip(run.tolist(), fingerprints(s, run, wide).tolist(), strict=True):
                    near = table.within(mark)
                    bag = Counter(s[start : start + wide].tolist()) if near else None
                    for item, distance in near:
                        if (sim := similarity(bag, table.items[item][1])) >= self.threshold:
                            best[item].append((-sim, start, distance))
        out = []
        for item, found in best.items():
            taken: list[int] = []
            for sim, start, distance in sorted(found):
                if all(abs(start - x) >= n for x in taken):
                    taken.append(start)
                    out.append((table.items[item][0], start, n, distance, -sim))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The items in broadcast blocks of bounded size; the driver holds one block at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        rows = items.filter(block == k).orderBy("i", "t").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(list(zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each span of a document that is near an item: ids, span in words, distance, similarity."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text):
        found = narrow.mapInArrow(_finder(items), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(items: Broadcast):
    def run(batches):
        tool = Detector(items.value)
        for batch in batches:
            for part in slices(batch):
                rows = [(doc, *leak) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for leak in tool.find(text)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a leak, with exactly their columns; nothing is joined or shuffled."""
    out, columns = docs, docs.columns
    at = columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text):
        out = out.mapInArrow(_keeper(items, at), docs.schema)
    return out


def _keeper(items: Broadcast, at: int):
    def run(batches):
        tool = Detector(items.value)
        for batch in batches:
            for part in slices(batch):
                clean = pa.array([not tool.find(text) for text in part.column(at).to_pylist()], pa.bool_())
                yield part.filter(clean)

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items in all documents."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
