"""Token counts by the whole-token shortcut, and token ids, for byte-level BPE vocabularies.

Offline, every vocabulary string that is one pre-token is encoded alone; those that come back as
one id are *whole*. A pre-token is merged without regard to its neighbours, so a whole string
counts as one wherever it is a pre-token. Texts are cut into pre-tokens, whole ones are counted by
a set look-up, and only the rest is merged, each different one once, with a bounded memory of
results.

The cut is made by a regular expression whose Unicode tables are newer than the tokenizer
library's. They agree on every assigned code point (a test goes through all of them); a text with a
code point that is unassigned in Python's own tables is encoded in full by the library instead.

Defined results: a null text is empty; an empty text has no tokens. Special strings inside texts
are one token each, the library's default. Repeated rows, null ids and extra columns change
nothing. An empty table gives an empty result. Whole texts are encoded, however long.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Cuts of the vocabulary's pre-tokenizer (a fixed format of the vocabulary file).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of the commonest scripts, all assigned: texts of these alone need no further look.
COMMON = r"[\x00-ͷЀ-ԯ -⁤₠-⃀℀-↋←-␦①-⭳　-〿ぁ-ゖ゙-ヿ一-鿿가-힣！-ﾾ\U0001F300-\U0001F6D7]"
#: Results of merges that a worker remembers.
MEMORY = 400_000
LIMIT = 512


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand
    for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def unassigned() -> regex.Pattern:
    """A search for code points without a category, on which Unicode tables of other years may differ."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs) + "]")


_common = regex.compile(f"{COMMON}*+")


def settled(text: str) -> bool:
    """No code point of the text is unassigned."""
    return text.isascii() or bool(_common.fullmatch(text)) or not unassigned().search(text)


def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    alphabet = _alphabet()
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    return {bytes(alphabet[c] for c in s): i for s, i in held["model"]["vocab"].items() if s not in special}, special


class WholeTokenCounter:
    """Counts tokens of texts; make it once in a worker."""

    def __init__(self, path: str):
        self.library = library(path)
        self.cut = regex.compile(PRETOKEN)
        words, special = _vocabulary(path)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole = self.prove(words)
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def prove(self, words: dict[bytes, int]) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        found = []
        for raw in words:
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
            if self.cut.findall(s) == [s] and settled(s):
                found.append(s)
        encoded = self.library.encode_batch_fast(found, add_special_tokens=False)
        return frozenset(s for s, e in zip(found, encoded, strict=True) if len(e) == 1)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        unsafe: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not settled(text):
                unsafe.append(i)
                continue
            parts = [text]
            if self.special and self.special.search(text):
                out[i] += len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                pieces = self.cut.findall(part)
                n = list(map(self.known.get, pieces))
                try:
                    out[i] += sum(n)
                except TypeError:  # some aren't known yet
                    out[i] += sum(x for x in n if x)
                    pending.append((i, [p for p, x in zip(pieces, n, strict=True) if x is None]))
        if pending:
            rest = list({p for _, ps in pending for p in ps})
            merged = {p: len(e) for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
            for i, ps in pending:
                out[i] += sum(map(merged.__getitem__, ps))
            if len(self.known) + len(merged) > len(self.whole) + MEMORY:
                self.known = dict.fromkeys(self.whole, 1)
            self.known |= dict(list(merged.items())[:MEMORY])
        for i, e in zip(unsafe, self.library.encode_batch_fast([texts[i] for i in unsafe], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The vocabulary's ids, by a second implementation of the same merges that is four times as
    fast; a test compares both over every code point and the corpus."""
    import tiktoken

    words, special = _vocabulary(path)
    return tiktoken.Encoding("byte-bpe", pat_str=PRETOKEN, mergeable_ranks=words, special_tokens=special)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; special strings are tokens, as the library's default has it.

    The library itself encodes what the fast encoder can't: texts with unassigned code points, and
    runs of about a million white-space characters, which end the stack of its cutter."""
    if settled(text):
        try:
            return np.asarray(encoder(path).encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except ValueError as e:
            if "stack" not in str(e):
                raise
    return np.asarray(library(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that one part's Python objects are all that a worker holds."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def batches_of(texts: list[str | None], most: int = 1 << 20) -> list[slice]:
    """Runs of texts of about ``most`` characters together; a longer text is a run of its own."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            out.append(slice(start, i))
            start, size = i, 0
        size += len(text or "")
    return [*out, slice(start, len(texts))] if texts else []


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``df`` (all its columns; one named ``out_col`` gives way) with the token count of each text."""
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(out_col)).schema
    at = df.columns.index(text_col)

    def run(batches):
        tool = counter(vocabulary)
        for batch in batches:
            for part in slices(batch):
                n = tool.counts([x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(n, pa.int64())], names=[*kept, out_col])

    return df.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, vocabulary_path())
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
