"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token of a text from the ``SIDE`` tokens on either side of it; the sum
of the conditional log-probabilities is the text's score. Tokens are words with A-Z in lower case:
the corpus's most frequent ones, and buckets of endings for all others; a word in a bucket adds its
log-probability there, by the counts of all words (``score_words``). The output is normalised in
two steps, a group of tokens and then a member of the group, so a token costs the square root of
the vocabulary.

What is gathered from the corpus grows with it: words are counted over all texts, and every
partition trains on its own texts: every token of every document is a target once a round, with its
neighbours as context, in batches that grow with the targets seen. After a round the partitions' weights
are averaged by targets, in a tree of ``FAN_IN``, and go out again; a model has a fixed size of about 350 kB.

The weights depend on how the rows lie in partitions, as in any averaged training; for one layout
they are the same in every run, so a lost executor's tasks give what they gave before.

Defined results: null and empty texts, and those without words, have no tokens, a sum of 0 and no
mean. Repeated rows get equal scores. Null ids stay. An empty table gives an empty result. Whole texts
are scored. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_staged, read_table, staged
from .shingles import words_and_endings_of
from .tokens import batches_of, slices

GROUPS = MEMBERS = 48
VOCABULARY = GROUPS * MEMBERS
ENDINGS = 256
WORDS = VOCABULARY - ENDINGS
SIDE = 2
SLOTS = (-2, -1, 1, 2)
EMBEDDED, HIDDEN = 12, 24
ROUNDS = 1
#: Targets of the first step and of the largest; between them a step takes a sixteenth of those seen.
BATCH, BATCH_MOST = 128, 2048
RATE = 0.08
FAN_IN = 128
#: Counted words that go to every worker, at most; rarer ones are joined.
TABLE = 1 << 20
#: Words that a worker counts before it hands the counts on.
COUNTED = 1_000_000
#: Tokens scored, or made ready for training, at once.
SCORED = 1 << 15
#: Of these, how many a score works on together; what it holds of them stays in a core's cache.
AT_ONCE = 1 << 12

#: The last row of each output layer is its bias.
_SHAPES = {
    "embedding": (VOCABULARY + 1, EMBEDDED), "slots": (len(SLOTS) * EMBEDDED, HIDDEN), "bias": (HIDDEN,),
    "groups": (HIDDEN + 1, GROUPS), "members": (GROUPS, HIDDEN + 1, MEMBERS),
}
_SIZES = {k: int(np.prod(v)) for k, v in _SHAPES.items()}


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each column less the column's maximum, in place, and the sums of the columns. Columns are long
    rows in memory, so that a step goes over all targets at once."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    return z, z.sum(axis=0)


@dataclass
class Network:
    """The weights, in one flat array."""

    flat: np.ndarray

    def __post_init__(self):
        at = 0
        for name, shape in _SHAPES.items():
            setattr(self, name, self.flat[at : at + _SIZES[name]].reshape(shape))
            at += _SIZES[name]

    @classmethod
    def started(cls, counts: np.ndarray, seed: int = 5) -> Network:
        """Small random weights; the biases are the corpus's own frequencies."""
        out = cls(np.random.default_rng(seed).normal(0, 0.1, sum(_SIZES.values())).astype(np.float32))
        c = (counts + 1.0).reshape(GROUPS, MEMBERS)
        out.bias[:] = 0
        out.groups[-1] = np.log(c.sum(axis=1) / c.sum())
        out.members[:, -1] = np.log(c / c.sum(axis=1, keepdims=True))
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, memory: np.ndarray, rate: float = RATE) -> None:
        """One adaptive gradient step on the mean loss of a batch; ``memory`` has the shape of ``flat``."""
        n = len(targets)
        grad = Network(np.zeros_like(self.flat))
        order = np.argsort(targets, kind="stable")  # a group's rows lie together
        contexts, targets = contexts[order], targets[order]
        group, member = np.divmod(targets, MEMBERS)
        row = np.arange(n)
        e = np.take(self.embedding, contexts.reshape(-1), axis=0).reshape(n, -1)  # slots side by side
        h = np.ones((n, HIDDEN + 1), np.float32)
        np.tanh(e @ self.slots + self.bias, out=h[:, :HIDDEN])
        dg, total = _exponentials(self.groups.T @ h.T)  # a column for each target
        dg /= total
        dg[group, row] -= 1
        np.matmul(h.T, dg.T, out=grad.groups)
        dh = dg.T @ self.groups.T
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        runs = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
        dm = np.empty((MEMBERS, n), np.float32)
        for k, at in runs:
            np.matmul(self.members[k].T, h[at].T, out=dm[:, at])
        dm, total = _exponentials(dm)
        dm /= total
        dm[member, row] -= 1
        for k, at in runs:
            np.matmul(h[at].T, dm[:, at].T, out=grad.members[k])
            dh[at] += dm[:, at].T @ self.members[k].T
        inner = h[:, :HIDDEN]
        dz = dh[:, :HIDDEN] * (1 - inner * inner)
        grad.slots[:] = e.T @ dz
        grad.bias[:] = dz.sum(axis=0)
        de = (dz @ self.slots.T).reshape(-1, EMBEDDED)
        cells = contexts.reshape(-1)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        grad.embedding[cells[starts]] = np.add.reduceat(np.take(de, order, axis=0), starts, axis=0)
        g = grad.flat
        g /= n
        memory += g * g
        g *= np.float32(rate)
        g /= np.sqrt(memory + np.float32(1e-6))
        self.flat -= g

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log P(target | both sides) of each row."""
        tables = np.matmul(self.embedding, self.slots.reshape(len(SLOTS), EMBEDDED, HIDDEN))  # the first layer, looked up
        order = np.argsort(targets, kind="stable")
        out = np.empty(len(targets), np.float32)
        for k in range(0, len(order), AT_ONCE):
            rows = order[k : k + AT_ONCE]
            out[rows] = self._sorted_log_probabilities(tables, np.take(contexts, rows, axis=0), targets[rows])
        return out

    def _sorted_log_probabilities(self, tables: np.ndarray, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The same for targets in order, so that a group's rows lie together."""
        z = self.bias + np.take(tables[0], contexts[:, 0], axis=0)
        for s in range(1, len(SLOTS)):
            z += np.take(tables[s], contexts[:, s], axis=0)
        h = np.ones((len(targets), HIDDEN + 1), np.float32)
        np.tanh(z, out=h[:, :HIDDEN])
        group, member = np.divmod(targets, MEMBERS)
        row = np.arange(len(targets))
        p, total = _exponentials(self.groups.T @ h.T)  # a column for each target
        q = np.empty((MEMBERS, len(targets)), np.float32)
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for k in range(int(group[0]), int(group[-1]) + 1):
            at = slice(ends[k], ends[k + 1])
            np.matmul(self.members[k].T, h[at].T, out=q[:, at])
        q, inside = _exponentials(q)
        tiny = np.float32(1e-38)  # a probability that float32 can't hold
        return np.log(np.maximum(p[group, row], tiny)) - np.log(total) + np.log(np.maximum(q[member, row], tiny)) - np.log(inside)


class Tokens:
    """Texts to ids. ``vocabulary`` holds hashes of words, most frequent first."""

    def __init__(self, vocabulary: np.ndarray):
        self.order = np.argsort(vocabulary).astype(np.int16)
        self.sorted = np.sort(vocabulary)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        return self.ids_and_words(texts)[:2]

    def ids_and_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the words' hashes."""
        hashes, endings, counts = words_and_endings_of(texts)
        out = (endings % np.uint64(ENDINGS)).astype(np.int16) + np.int16(WORDS)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]]
        return out, counts, hashes


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``SIDE`` tokens for an edge before and after every text, and each id's place there."""
    at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(counts)), counts) + 1)
    wide = np.full(len(ids) + SIDE * (len(counts) + 1), VOCABULARY, np.int16)
    wide[at] = ids
    return wide, at


def contexts_of(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The neighbours of the tokens at the given places."""
    return wide[at[:, None] + np.array(SLOTS)]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, bucket, n) over all texts, words by their hash; each worker counts before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush():
            hashes, endings = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at, n = np.unique(hashes, return_index=True, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((endings[at] % np.uint64(ENDINGS)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "bucket", "n"])

        for batch in batches:
            for part in slices(batch):
                texts = part.column(0).to_pylist()
                for run_of in batches_of(texts):
                    held.append(words_and_endings_of(texts[run_of])[:2])
                    waiting += len(held[-1][0])
                    if waiting >= COUNTED:
                        yield flush()
                        waiting = 0
        if held:
            yield flush()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, bucket int, n long")
    return rows.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", words: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words (ties by hash) and the count of every token of the model.
    ``words`` are the staged word counts, if there are any."""
    counts = staged(word_counts(docs, text_col), "word-counts") if words is None else words
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    totals = np.zeros(VOCABULARY)
    totals[: len(top)] = [r["n"] for r in top]
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[WORDS + r["bucket"]] = r["n"]
    for r in top:
        totals[WORDS + r["bucket"]] -= r["n"]
    if words is None:
        drop_staged(counts)
    return np.array([r["word"] for r in top], np.int64).view(np.uint64), totals


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, words: DataFrame | None = None) -> tuple[np.ndarray, Network]:
    """Count, then let all partitions train and average, ``rounds`` times."""
    known, counts = vocabulary(docs, text_col, words)
    model = Network.started(counts)
    texts = docs.select(F.col(text_col).alias("text"))
    for _ in range(rounds):
        model = _averaged(texts, known, model) or model
    return known, model


class Trainer:
    """Trains one partition's copy of a model on contexts and targets as they come."""

    def __init__(self, flat: np.ndarray):
        self.own, self.memory = Network(flat.copy()), np.zeros_like(flat)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.seen = 0

    def size(self) -> int:
        return min(BATCH_MOST, max(BATCH, 1 << (self.seen // 16).bit_length()))

    def add(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        self.held.append((contexts, targets))
        self.waiting += len(targets)
        if self.waiting >= self.size():
            self._steps(last=False)

    def finish(self) -> None:
        """Train on what is still held."""
        if self.waiting:
            self._steps(last=True)

    def _steps(self, last: bool) -> None:
        c, t = (np.concatenate(x) for x in zip(*self.held, strict=True))
        at = 0
        while len(t) - at >= self.size() or (last and at < len(t)):
            step = slice(at, min(at + self.size(), len(t)))
            self.own.train(c[step], t[step], self.memory)
            self.seen += step.stop - at
            at = step.stop
        self.held, self.waiting = [(c[at:], t[at:])], len(t) - at


def _averaged(texts: DataFrame, known: np.ndarray, model: Network) -> Network | None:
    shared = texts.sparkSession.sparkContext.broadcast((known, model.flat))  # fixed size

    def run(batches):
        from pyspark import TaskContext

        names, flat = shared.value
        tool, trainer = Tokens(names), Trainer(flat)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(0).to_pylist()
                for run_of in batches_of(texts):
                    ids, counts = tool.ids(texts[run_of])
                    wide, at = padded(ids, counts)
                    for i in range(0, len(at), SCORED):
                        places = at[i : i + SCORED]
                        trainer.add(contexts_of(wide, places), wide[places])
        trainer.finish()
        if trainer.seen:
            yield _model_row(TaskContext.get().partitionId(), trainer.own.flat, trainer.seen)

    models = staged(texts.mapInArrow(run, "team long, flat binary, n long"), "models")
    while models.count() > FAN_IN:
        teams = models.withColumn("team", F.floor(F.col("team") / FAN_IN).cast("long"))
        fewer = staged(teams.groupBy("team").applyInArrow(lambda key, t: pa.Table.from_batches([_model_row(key[0].as_py(), *_mean(t.to_pylist()))]), "team long, flat binary, n long"), "models")
        drop_staged(models)
        models = fewer
    rows = [r.asDict() for r in models.collect()]  # FAN_IN models at most
    drop_staged(models)
    return Network(_mean(rows)[0]) if rows else None


def _model_row(team: int, flat: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([team], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["team", "flat", "n"])


def _mean(rows: list[dict]) -> tuple[np.ndarray, int]:
    """Weights averaged by targets seen, summed in order of team."""
    total, n = np.zeros(sum(_SIZES.values())), 0
    for r in sorted(rows, key=lambda r: r["team"]):
        total += r["n"] * np.frombuffer(r["flat"], np.float32).astype(np.float64)
        n += r["n"]
    return (total / n).astype(np.float32), n


def score(docs: DataFrame, known: np.ndarray, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_probability) of each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((known, model.flat))  # fixed size

    def run(batches):
        names, flat = shared.value
        tool, net = Tokens(names), Network(flat)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                n, sums = [], []
                for run_of in batches_of(texts):
                    ids, counts = tool.ids(texts[run_of])
                    wide, at = padded(ids, counts)
                    own = np.repeat(np.arange(len(counts)), counts)
                    got = np.zeros(len(counts))
                    for i in range(0, len(at), SCORED):
                        p = at[i : i + SCORED]
                        got += np.bincount(own[i : i + SCORED], net.log_probabilities(contexts_of(wide, p), wide[p]), len(counts))
                    n += counts.tolist()
                    sums += got.tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array([s / m if m else None for s, m in zip(sums, n, strict=True)], pa.float64())],
                    names=["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"],
                )

    return narrow.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_probability double")


def common_words(rest: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, ascending, and log counts of the most frequent of ``rest(word, n)``, ``TABLE`` at most, and the
    count that all of them reach: words of at least this count are all here."""
    step = F.floor(F.log2("n") * 16)  # counts in steps of a sixteenth of a doubling: about a thousand steps at most
    sizes = {r["step"]: (r["rows"], r["least"]) for r in rest.filter("n > 1").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()}
    held, least = 0, 1 << 62
    for k in sorted(sizes, reverse=True):
        if (held := held + sizes[k][0]) > TABLE:
            break
        least = sizes[k][1]
    else:
        least = 2
    found = rest.filter(F.col("n") >= least).select("word", "n").toArrow()  # TABLE rows at most
    words, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(words)
    return words[order], np.log(n[order]), least


def score_words(docs: DataFrame, known: np.ndarray, model: Network, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``score``, but a word outside the model's own also counts with log P(word | its bucket).

    With N words counted in the bucket, a word counted n times has n / (N + 1) of it; those that were
    never counted share what is left. The most frequent words go to every worker in a table of bounded
    size; where that doesn't hold all words counted more than once, the others are joined, whatever
    their number.
    """
    rest = words.filter(~F.col("word").isin(known.view(np.int64).tolist())) if len(known) else words
    sizes = np.zeros(ENDINGS)
    for r in rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ENDINGS rows
        sizes[r["bucket"]] = r["n"]
    common, logs, least = common_words(rest)
    joined = least > 2
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((known, model.flat, np.log(sizes + 1), common, logs))  # bounded by TABLE

    def run(batches):
        from pyspark import TaskContext

        names, flat, less, common, logs = shared.value
        tool, net = Tokens(names), Network(flat)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                for run_of in batches_of(texts):
                    ids, counts, hashes = tool.ids_and_words(texts[run_of])
                    wide, at = padded(ids, counts)
                    own = np.repeat(np.arange(len(counts)), counts)
                    got = np.zeros(len(counts))
                    for i in range(0, len(at), SCORED):
                        p = at[i : i + SCORED]
                        got += np.bincount(own[i : i + SCORED], net.log_probabilities(contexts_of(wide, p), wide[p]), len(counts))
                    rare = np.flatnonzero(ids >= WORDS)
                    got -= np.bincount(own[rare], less[ids[rare] - WORDS], len(counts))
                    if len(common):
                        place = np.minimum(np.searchsorted(common, hashes[rare]), len(common) - 1)
                        held = common[place] == hashes[rare]
                        got += np.bincount(own[rare[held]], logs[place[held]], len(counts))
                        rare = rare[~held]
                    columns = [part.column(0)[run_of], pa.array(counts, pa.int64()), pa.array(got)]
                    if joined:
                        ends = np.concatenate([[0], np.cumsum(np.bincount(own[rare], minlength=len(counts)))])
                        columns += [pa.array(key + np.arange(len(counts))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[rare].view(np.int64)))]
                        key += len(counts)
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "sum", "key", "rare"][: len(columns)])

    schema = "doc_id long, n_tokens long, sum double"
    if joined:
        # rows get their keys once, as they are written
        rows = staged(narrow.mapInArrow(run, f"{schema}, key long, rare array<long>"), "scored")
        # logarithms in fixed point, so sums don't depend on their order; a count of 1 adds nothing
        bits = rest.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", F.round(F.log("n") * float(1 << 32)).cast("long").alias("bits"))
        sums = rows.select("key", F.explode("rare").alias("word")).join(bits, "word").groupBy("key").agg(F.sum("bits").alias("bits"))
        out = rows.drop("rare").join(sums, "key", "left").withColumn("log_likelihood", F.col("sum") + F.coalesce("bits", F.lit(0)) / float(1 << 32))
    else:
        out = narrow.mapInArrow(run, schema).withColumnRenamed("sum", "log_likelihood")
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document, word by word, under a network trained on all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = staged(word_counts(docs), "word-counts")
    return score_words(docs, *train(docs, words=words), words)
