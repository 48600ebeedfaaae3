"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into ``2**WORD_BITS`` places with dampened and
length-normalised counts, and one place for each statistic of its structure (shares of symbols,
capitals, digits, repeated windows, repeated lines, stutter, vocabulary, sizes) and its stored
length. The machine adds to the linear model all pairwise interactions through ``RANK`` factors,
scored in linear time by half of (sum of v*x) squared less the sum of squares.

It is trained in numpy on at most ``SAMPLE`` labelled rows, those of least hash of their id, a bound
that doesn't grow with the corpus. Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never
learned from, as are rows without an id. Neither labels, language, source nor id is an input.

Defined results: a null or empty text has no words and gets the score of zero statistics; a missing
stored length counts as the text's own. Repeated rows get equal scores. With no labelled rows to
learn from all scores are 0.5. An empty table gives an empty result. Several labels of one id count
by their least value. Whole texts are read. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .shingles import SHINGLE, shingle_hashes, word_hashes
from .tokens import slices

WORD_BITS = 15
RANK = 8
#: Labelled rows that the machine is trained on, at most.
SAMPLE = 6000
EPOCHS = 12
RATE = 0.05
DECAY = 1e-5
CUT = 0.3

STATS = (
    "bias", "log_words", "log_chars", "word_length", "symbols", "bars", "marks", "capitals", "digits", "other", "distinct",
    "repeat_windows", "repeat_lines", "stutter", "short_lines", "top_word", "log_lines", "log_stored", "stored_gap", "no_words",
)
N_FEATURES = (1 << WORD_BITS) + len(STATS)


def statistics(text: str, raw: bytes, hashes: np.ndarray, counts: np.ndarray, stored: float | None) -> np.ndarray:
    n = len(hashes) or 1
    codes = np.frombuffer(raw, np.uint8)
    size = len(codes) or 1
    capital = int(((codes >= 65) & (codes <= 90)).sum())
    digit = int(((codes >= 48) & (codes <= 57)).sum())
    letters = int(((codes | 32) >= 97).sum())
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"~", b"^", b"=", b"_", b"\\")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = shingle_hashes(hashes) if len(hashes) >= SHINGLE else hashes[:0]
    repeated = 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0
    m = len(lines) or 1
    own = float(len(text))
    stored = own if stored is None else float(stored)
    return np.array(
        [
            1.0,
            np.log1p(len(hashes)) / 8,
            np.log1p(size) / 10,
            min(size / n, 40) / 10,
            min(symbols / n, 4),
            min(raw.count(b"|") / n, 2) * 2,
            min((raw.count(b"!") + raw.count(b"?")) / n, 3),
            capital / size * 2,
            digit / size * 4,
            max(0.0, 1 - letters / size) * 2,
            len(counts) / n,
            repeated * 2,
            (1 - len(set(lines)) / m) * 2,
            float((hashes[1:] == hashes[:-1]).sum()) / n * 2,
            sum(len(x) < 40 for x in lines) / m,
            (counts.max() / n) if len(counts) else 0.0,
            np.log1p(len(lines)) / 5,
            np.log1p(max(stored, 0.0)) / 10,
            min(abs(stored - own) / (own + 1), 4),
            float(not len(hashes)),
        ],
        np.float32,
    )


def features(text: str | None, stored: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's vector, places ascending and distinct."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    hashes = word_hashes(text)
    places, counts = np.unique(hashes & np.uint64((1 << WORD_BITS) - 1), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    if len(values):
        values /= np.sqrt((values * values).sum())
    stats = statistics(text, raw, hashes, counts, stored)
    at = np.arange(1 << WORD_BITS, N_FEATURES)
    return np.concatenate([places.astype(np.int64), at]), np.concatenate([values, stats])


@dataclass
class FactorisationMachine:
    """``linear`` weights and ``factors``, one row for each place."""

    linear: np.ndarray
    factors: np.ndarray
    trained: bool = True

    @classmethod
    def untrained(cls, seed: int = 11) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return cls(np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.01, (N_FEATURES, RANK)).astype(np.float32), False)

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at]
        sums = x @ v
        squares = (x * x) @ (v * v)
        return float(self.linear[at] @ x + 0.5 * (sums @ sums - squares.sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        if not self.trained:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 11) -> FactorisationMachine:
        """Adaptive gradient steps on the logistic loss, one row at a time in a fixed shuffle."""
        out = cls.untrained(seed)
        if not rows:
            return out
        out.trained = True
        rng = np.random.default_rng(seed)
        gl, gv = np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, RANK), 1e-2, np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, x, y = rows[k]
                v = out.factors[at]
                sums = x @ v
                margin = out.linear[at] @ x + 0.5 * (sums @ sums - ((x * x) @ (v * v)).sum())
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
                step = error * x + decay * out.linear[at]
                gl[at] += step * step
                out.linear[at] -= rate * step / np.sqrt(gl[at])
                step = error * (x[:, None] * sums - v * (x * x)[:, None]) + decay * v
                gv[at] += step * step
                out.factors[at] = v - rate * step / np.sqrt(gv[at])
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows of the fold that isn't learned from, and for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """The machine fitted to at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("__c_id")).agg(F.min(label_col).cast("int").alias("__c_y"))
    chosen = known.orderBy(F.xxhash64("__c_id"), "__c_id").limit(sample)
    stored = F.col(length_col).cast("double") if length_col and length_col in docs.columns else F.lit(None).cast("double")
    narrow = docs.select(F.col(id_col).cast("long").alias("__c_id"), F.col(text_col).alias("__c_text"), stored.alias("__c_stored"))
    rows = narrow.join(F.broadcast(chosen), "__c_id")  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, texts, sizes, ys = (part.column(i).to_pylist() for i in range(4))
                found = [features(t, s) for t, s in zip(texts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary()), pa.array(ys, pa.int32())],
                    names=["id", "at", "x", "y"],
                )

    vectors = rows.mapInArrow(run, "id long, at binary, x binary, y int")
    held = vectors.orderBy(F.xxhash64("id"), "id", "at", "x").limit(sample).collect()
    return FactorisationMachine.fit([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32), r["y"]) for r in held])


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """(doc_id, score) of each row."""
    stored = F.col(length_col).cast("double") if length_col and length_col in docs.columns else F.lit(None).cast("double")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), stored.alias("stored"))
    # a model of fixed size: N_FEATURES * (RANK + 1) numbers
    shared = docs.sparkSession.sparkContext.broadcast((machine.linear, machine.factors, machine.trained))

    def run(batches):
        model = FactorisationMachine(*shared.value)
        for batch in batches:
            for part in slices(batch):
                scores = [model.score(*features(t, s)) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a machine that never saw the held-out fold's labels."""
    docs = read_table(spark, sf_dir, "documents")
    machine = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
