"""Server-sent frames: cutting, restoration across cuts, running totals, expiring mappings."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns as P
from ..operators.code import restore

HOLDBACK = 24
_TAIL = re.compile(r"[A-Za-z0-9_$]+$")


def frames(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, frame): a text cut at blank lines; a last part without one counts too, empty ones don't."""
    return df.select(key, F.posexplode(F.split(text, "\n\n", -1)).alias("seq", "frame")).filter(F.length("frame") > 0)


class ChunkDecoder:
    """Bytes in, whole frames out: characters and frames may be cut anywhere between chunks."""

    def __init__(self, held: bytes = b"", text: str = ""):
        self.held, self.text = held, text

    def push(self, chunk: bytes) -> list[str]:
        raw = self.held + chunk
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.text += decoder.decode(raw)
        self.held = decoder.getstate()[0]
        *whole, self.text = self.text.split("\n\n")
        return [x for x in whole if x]

    def flush(self) -> list[str]:
        last, self.text, self.held = self.text + self.held.decode("utf-8", "replace"), "", b""
        return [last] if last else []


def decode_chunks(df: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, seq, frame) of streams that come as binary chunks; a task holds one stream's tail."""

    def run(batches):
        at, tool, seq = None, None, 0

        def rows(found):
            nonlocal seq
            out = [(at, seq + i, x) for i, x in enumerate(found)]
            seq += len(out)
            return out

        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tool is None or k != at:
                    out += rows(tool.flush()) if tool else []
                    at, tool, seq = k, ChunkDecoder(), 0
                out += rows(tool.push(raw or b""))
            if out:
                yield _frame_batch(out)
        if tool and (out := rows(tool.flush())):
            yield _frame_batch(out)

    def _frame_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=["k", "seq", "frame"])

    narrow = df.select(F.col(key).cast("string").alias("k"), F.col(chunk).alias("c"), F.col(order).alias("o"))
    return narrow.repartition("k").sortWithinPartitions("k", "o").select("k", "c").mapInArrow(run, "k string, seq int, frame string").withColumnRenamed("k", key)


def debounced(df: DataFrame, key: str, ts: str, tie: str, ms: int = 150) -> DataFrame:
    """The last of each burst of changes: those that no other follows within ``ms`` milliseconds."""
    from pyspark.sql import Window

    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") >= ms * 1000)).drop("__gap")


def within_bytes(df: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """``df`` with the running bytes of each stream, and whether they are within the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(value)).over(w)).withColumn("is_within", F.col("bytes_so_far") <= most)


def cut_point(text: str, holdback: int = HOLDBACK) -> int:
    """Where held text may be cut: ``holdback`` characters stay, and no word is cut."""
    at = max(0, len(text) - holdback)
    m = _TAIL.search(text[:at])
    if m and at < len(text) and re.match(r"[A-Za-z0-9_$]", text[at]):
        at = m.start()
    return at


class FrameRestorer:
    """One stream: frames in, frames out. Text of a block is held back by a tail; arguments of a call
    are held until their block stops. What isn't one JSON ``data:`` line passes unchanged."""

    def __init__(self, back: dict[str, str], holdback: int = HOLDBACK, buffer_text: bool = False, state: dict | None = None):
        self.back, self.holdback, self.buffer = back, holdback, buffer_text
        self.text: dict[str, str] = (state or {}).get("text", {})
        self.args: dict[str, str] = (state or {}).get("args", {})

    def state(self) -> dict:
        return {"text": self.text, "args": self.args}

    @staticmethod
    def _delta(index: int, kind: str, value: str) -> str:
        name = "text" if kind == "text_delta" else "partial_json"
        body = {"type": "content_block_delta", "index": index, "delta": {"type": kind, name: value}}
        return "event: content_block_delta\ndata: " + json.dumps(body, ensure_ascii=False, separators=(",", ":"))

    def push(self, frame: str) -> list[str]:
        data = [x[5:].strip() for x in frame.split("\n") if x.startswith("data:")]
        if len(data) != 1:
            return [frame]
        try:
            body = json.loads(data[0])
            kind, index = body.get("type"), body.get("index")
        except (ValueError, AttributeError):
            return [frame]
        k = str(index)
        delta = body.get("delta") if isinstance(body.get("delta"), dict) else {}
        if kind == "content_block_delta" and delta.get("type") == "text_delta" and isinstance(delta.get("text"), str):
            held = self.text.get(k, "") + delta["text"]
            at = 0 if self.buffer else cut_point(held, self.holdback)
            self.text[k] = held[at:]
            return [self._delta(index, "text_delta", restore(held[:at], self.back))] if at else []
        if kind == "content_block_delta" and delta.get("type") == "input_json_delta" and isinstance(delta.get("partial_json"), str):
            self.args[k] = self.args.get(k, "") + delta["partial_json"]
            return []
        if kind == "content_block_stop":
            return [*self.flush(k), frame]
        return [frame]

    def flush(self, only: str | None = None) -> list[str]:
        """Held text, then held arguments, of one block or of all."""
        out = []
        for k in [only] if only is not None else sorted({*self.text, *self.args}):
            if held := self.text.pop(k, ""):
                out.append(self._delta(int(k), "text_delta", restore(held, self.back)))
            if held := self.args.pop(k, ""):
                out.append(self._delta(int(k), "input_json_delta", restore(held, self.back)))
        return out


def restore_frames(df: DataFrame, key: str, order: str, frame: str, mapping: dict[str, str], holdback: int = HOLDBACK, buffer_text: bool = False) -> DataFrame:
    """Batch twin of the stream: (key, seq, frame) restored, each stream in its order. With
    ``buffer_text`` a block's text is held until the block stops, as rewriting of comments needs it."""
    schema = f"{key} string, seq long, frame string"

    def run(k, rows: pd.DataFrame) -> pd.DataFrame:
        tool = FrameRestorer(mapping, holdback, buffer_text)
        out = [x for f in rows.sort_values(order)[frame] for x in tool.push(f)] + tool.flush()
        return pd.DataFrame({key: [str(k[0])] * len(out), "seq": range(len(out)), "frame": out})

    return df.withColumn(key, F.col(key).cast("string")).groupBy(key).applyInPandas(lambda k, rows: run(k, rows), schema)


class FrameProcessor(StatefulProcessor):
    """The stream itself: state is the held tails; a stream that is idle for ``idle_ms`` is flushed."""

    def __init__(self, mapping: dict[str, str], holdback: int = HOLDBACK, idle_ms: int = 30_000):
        self.mapping, self.holdback, self.idle = mapping, holdback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")

    def _tool(self) -> FrameRestorer:
        return FrameRestorer(self.mapping, self.holdback, state=json.loads(self.held.get()[0]) if self.held.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tool, out = self._tool(), []
        for part in rows:
            for f in part.sort_values("seq")["frame"]:
                out += tool.push(f)
        self.held.update((json.dumps(tool.state()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "frame": out}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tool = self._tool()
        out = tool.flush()
        self.held.clear()
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "frame": out}, dtype=object)

    def close(self) -> None:
        pass


def restore_stream(df: DataFrame, mapping: dict[str, str], holdback: int = HOLDBACK, idle_ms: int = 30_000) -> DataFrame:
    """Streaming restoration of (stream_id, seq, frame). The session needs the RocksDB state store."""
    return df.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=FrameProcessor(mapping, holdback, idle_ms), outputStructType="stream_id string, frame string", outputMode="Append", timeMode="ProcessingTime"
    )


def running_totals(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts of each category by day; with a watermark late days are let go."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(*[F.count_if(F.col("category") == c).alias(c) for c in P.CATEGORIES]).select(F.col("w.start").alias("day"), *P.CATEGORIES)


def tally_line(counts: Column | None = None) -> Column:
    """One line of running totals."""
    return F.format_string("identifiers %d, comments %d, strings %d, secrets %d", *[F.col(c) for c in P.CATEGORIES])


class MappingProcessor(StatefulProcessor):
    """A session's names with idle expiry and capacity: a look-up refreshes a name, so it is written
    again; the oldest inserted goes first when the session is full."""

    def __init__(self, ttl_ms: int, capacity: int):
        self.ttl, self.capacity = ttl_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getValueState("names", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = json.loads(self.names.get()[0]) if self.names.exists() else {"n": 0, "of": {}}
        held["of"] = {k: v for k, v in held["of"].items() if now - v[1] < self.ttl}
        out = []
        for part in rows:
            for name in part.sort_values("seq")["name"]:
                if name not in held["of"]:
                    held["n"] += 1
                    held["of"][name] = [held["n"], now]
                    while len(held["of"]) > self.capacity:
                        held["of"].pop(next(iter(held["of"])))
                held["of"][name][1] = now
                out.append((name, held["of"][name][0]))
        self.names.update((json.dumps(held),))
        yield pd.DataFrame({"session": [key[0]] * len(out), "name": [x for x, _ in out], "number": [n for _, n in out]}, dtype=object)

    def close(self) -> None:
        pass


def mapping_stream(df: DataFrame, ttl_ms: int = 1_800_000, capacity: int = 10_000) -> DataFrame:
    """Streaming numbering of (session, seq, name)."""
    return df.groupBy("session").transformWithStateInPandas(
        statefulProcessor=MappingProcessor(ttl_ms, capacity), outputStructType="session string, name string, number long", outputMode="Append", timeMode="ProcessingTime"
    )
