"""Packing token sequences: bounded-space online best fit.

Each partition streams its documents once and keeps a fixed number of open windows. A document is
cut into full windows and a remainder; the remainder goes into the open window that it leaves
fullest. When it fits none, the fullest window is emitted: if its gap is at least ``MIN_CUT`` tokens
the remainder is cut to fill it, otherwise the gap becomes padding. At the end of a partition its
open windows are leftovers; groups of ``FAN_IN`` partitions merge theirs, cutting freely, so that
each group ends in at most one window that isn't full.

A task holds ``open_windows`` windows of tokens, whatever its input; a merge holds ``FAN_IN`` times
that. The pieces are written once to the shared folder, so no text is encoded twice and a lost
executor costs only its own tasks.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they
come. A null id is kept as null. An empty table gives no pieces. Very long texts give as many full
windows as they need. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, staged
from .tokens import encode, slices, vocabulary_path

WINDOW = 2048
OPEN_WINDOWS = 32
#: A gap smaller than this is padded rather than filled by cutting a document.
MIN_CUT = 64
END_ID = 1
#: Partitions whose leftovers one task merges.
FAN_IN = 64
#: Sequence numbers that one partition may use.
SPAN = 1 << 32

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover_of int"


class Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.used = 0


class OnlinePacker:
    """Windows of one partition; ``closed`` gathers rows that are done."""

    def __init__(self, first_sequence: int, size: int, most_open: int, min_cut: int):
        self.next, self.size, self.most, self.min_cut = first_sequence, size, most_open, min_cut
        self.open: list[tuple[int, int, Window]] = []  # by tokens used, then age
        self.age = 0
        self.closed: list[tuple] = []

    def emit(self, window: Window) -> None:
        at = 0
        for doc, start, ids, total in window.pieces:
            self.closed.append((doc, start, len(ids), total, self.next, at, ids.tobytes(), None))
            at += len(ids)
        self.next += 1

    def _put(self, window: Window, doc, start: int, ids: np.ndarray, total: int) -> None:
        window.pieces.append((doc, start, ids, total))
        window.used += len(ids)
        if window.used == self.size:
            self.emit(window)
        else:
            insort(self.open, (window.used, self.age, window), key=lambda x: x[:2])
            self.age += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            window = Window()
            window.pieces.append((doc, start, ids[: self.size], total))
            self.emit(window)
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            # the fullest window that still takes all of it
            k = bisect_left(self.open, self.size - len(ids) + 1, key=lambda x: x[0]) - 1
            if k >= 0:
                return self._put(self.open.pop(k)[2], doc, start, ids, total)
            if len(self.open) < self.most:
                return self._put(Window(), doc, start, ids, total)
            used, _, window = self.open.pop()
            if (gap := self.size - used) >= self.min_cut:
                self._put(window, doc, start, ids[:gap], total)
                start, ids = start + gap, ids[gap:]
            else:
                self.emit(window)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int32()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit). Concatenating a document's pieces by ``start`` gives its ids."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = OnlinePacker(part * SPAN, size, open_windows, min_cut)
        for batch in batches:
            for rows in slices(batch, 256):
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or "", vocabulary), np.uint32(end_id))
                    packer.add(doc, 0, ids, len(ids))
                if packer.closed:
                    yield _batch(packer.closed)
                    packer.closed = []
        left = [(doc, start, len(ids), total, part * SPAN + age, 0, ids.tobytes(), part) for _, age, w in packer.open for doc, start, ids, total in w.pieces]
        yield _batch(left)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(docs.mapInArrow(run, SCHEMA), "pieces")

    def merge(key, table: pa.Table) -> pa.Table:
        """Leftovers in order of partition, window and place; each window is filled to the brim."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["leftover_of"], r["sequence_id"], str(r["doc_id"]), r["start"]))
        packer = OnlinePacker((key[0].as_py() * FAN_IN) * SPAN + SPAN // 2, size, 1, 1)
        for r in rows:
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"])
        for _, _, w in packer.open:
            packer.emit(w)
        return pa.Table.from_batches([_batch(packer.closed)])

    leftovers = pieces.filter("leftover_of IS NOT NULL").withColumn("team", F.floor(F.col("leftover_of") / FAN_IN).cast("long"))
    merged = leftovers.groupBy("team").applyInArrow(lambda key, t: merge(key, t.drop_columns(["team"])), SCHEMA)
    return pieces.filter("leftover_of IS NULL").unionByName(merged).drop("leftover_of")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    out = pack(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
