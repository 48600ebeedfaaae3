"""Whole request bodies: every routed field transformed in place, with counters and labels.

Names of a session depend on those before, so a session's requests pass one task in order of their
number. They are streamed: a task holds the session's names, not its requests, and a row has the names
of its own request, so that rows don't grow with the session.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import code

FIELDS = {"Edit": ("old_string", "new_string"), "Write": ("content",)}
_PREFIX = re.compile(P.LINE_PREFIX)


def strip_numbers(text: str) -> tuple[str, list[str]] | None:
    """Source and prefixes of numbered lines, as the column function has it."""
    lines = text.split("\n")
    found = [_PREFIX.match(x) for x in lines]
    if len(lines) < 2 or not all(found):
        return None
    numbers = [int(m[0]) for m in found]
    if any(b != a + 1 for a, b in zip(numbers, numbers[1:], strict=False)):
        return None
    return "\n".join(x[m.end() :] for x, m in zip(lines, found, strict=True)), [m[0] for m in found]


class Transformer:
    """Transforms bodies of one session. In ``pool`` mode names come from the session's pool and a
    failure lets the body through; in ``coherent`` mode each file is told in one domain and a failure
    rejects the body."""

    def __init__(self, mode: str = "pool", style: str = "compact", max_lines: int = 5000):
        self.mode, self.names, self.max_lines = mode, code.Names(style), max_lines
        self.plans: dict[str, str] = {}  # the domain of each label
        self.mapping: dict[str, str] = {}
        self.stats = dict.fromkeys(("names", "comments", "strings", "constants"), 0)
        self.labels: list[tuple[str, int]] = []
        self.hidden: list[tuple[str, str]] = []
        self.domains: list[str] = []

    def source(self, text: str, label: str) -> str:
        if not isinstance(text, str) or not text:
            return text
        numbered = strip_numbers(text)
        plain = numbered[0] if numbered else text
        if self.mode == "coherent":
            d = code.disguise(plain, self.plans.get(label))
            if not d.domain:
                return text
            if not d.valid:
                raise ValueError(d.reason)
            self.plans[label] = d.domain
            self.mapping |= d.mapping
            if d.domain not in self.domains:
                self.domains.append(d.domain)
            self.hidden += [("identifier", x) for x in d.mapping] + [("comment", x) for x in d.comments.values()] + [("string", x) for x in d.strings.values()]
            out, n = d.output, len(d.mapping)
            self.stats["comments"] += len(d.comments)
            self.stats["strings"] += len(d.strings)
        else:
            r = code.obfuscate(plain, self.names, max_lines=self.max_lines)
            out, n = r.output, len(r.declarations)
            self.hidden += r.hidden
            self.stats["comments"] += r.comments
            self.stats["strings"] += r.strings
            self.stats["constants"] += r.constants
        self.stats["names"] += n
        self.labels.append((label, n))
        if numbered:
            lines = out.split("\n")
            return "\n".join(p + x for p, x in zip(numbered[1], lines, strict=True)) if len(lines) == len(numbered[1]) else text
        return out

    def body(self, raw: str | None) -> tuple[str | None, str | None]:
        """(body, error): what isn't a body passes through."""
        try:
            body = json.loads(raw) if raw else None
        except ValueError:
            return (raw, None) if self.mode == "pool" else (None, "not json")
        if not isinstance(body, dict) or not isinstance(body.get("messages"), list):
            return raw, None
        try:
            self._walk(body["messages"])
        except Exception as e:
            return (raw, None) if self.mode == "pool" else (None, str(e))
        return json.dumps(body, ensure_ascii=False, separators=(",", ":")), None

    def _walk(self, messages: list) -> None:
        blocks = [b for m in messages if isinstance(m, dict) and isinstance(m.get("content"), list) for b in m["content"] if isinstance(b, dict)]
        calls = {b["id"]: b for b in blocks if b.get("type") == "tool_use" and isinstance(b.get("id"), str)}
        for b in blocks:
            if b.get("type") == "tool_use" and isinstance(b.get("input"), dict):
                name, args = b.get("name"), b["input"]
                for f in FIELDS.get(name, ()) if isinstance(name, str) else ():
                    if f in args:
                        args[f] = self.source(args[f], self.label(b))
                if name == "Bash" and isinstance(args.get("command"), str):
                    args["command"] = code.obfuscate_known(args["command"], self.names)
            elif b.get("type") == "tool_result":
                call = calls.get(b.get("tool_use_id")) if isinstance(b.get("tool_use_id"), str) else None
                shell = call is not None and call.get("name") == "Bash"
                label = self.label(call) if call else "tool_result"
                change = (lambda t: code.obfuscate_known(t, self.names)) if shell else (lambda t, at=label: self.source(t, at))
                if isinstance(b.get("content"), str):
                    b["content"] = change(b["content"])
                elif isinstance(b.get("content"), list):
                    for part in b["content"]:
                        if isinstance(part, dict) and part.get("type") == "text" and isinstance(part.get("text"), str):
                            part["text"] = change(part["text"])

    @staticmethod
    def label(call: dict) -> str:
        args = call.get("input") if isinstance(call.get("input"), dict) else {}
        path, command = args.get("file_path"), args.get("command")
        if isinstance(path, str) and path:
            return path
        if call.get("name") == "Bash" and isinstance(command, str) and command:
            return "Bash: " + command[: P.LABEL_MOST] + ("…" if len(command) > P.LABEL_MOST else "")
        return str(call.get("name"))


SCHEMA = "output string, error string, names long, comments long, strings long, constants long, labels array<struct<label:string,renamed:long>>, mapping map<string,string>, domains array<string>, " + code.EVENTS


#: Requests, and characters of their results, that go to Spark at once.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20


def transform_bodies(df: DataFrame, session: str, number: str, body: str = "body", mode: str = "pool", style: str = "compact", max_lines: int = 5000) -> DataFrame:
    """(session, number, output, error, counters, labels, mapping, domains, events) of each request.

    ``mapping`` has the names that the request was the first to need and those that it met again; a
    session's names are those of all its rows (``session_names``). Requests of one number go in order of
    their text.
    """
    names = [session, number, "output", "error", "names", "comments", "strings", "constants", "labels", "mapping", "domains", "events"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("label", pa.string()), ("renamed", pa.int64())])), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), code.EVENTS_TYPE]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        where, tool, rows, held = None, None, [], 0
        for batch in batches:
            for own, n, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                own, n, raw = own.as_py(), n.as_py(), raw.as_py()
                if tool is None or own != where:
                    where, tool = own, Transformer(mode, style, max_lines)
                tool.stats, tool.labels, tool.hidden, tool.domains, tool.mapping = dict.fromkeys(tool.stats, 0), [], [], [], {}
                tool.names.met = {}
                output, error = tool.body(raw)
                known = tool.mapping if mode == "coherent" else tool.names.met
                rows.append((own, n, output, error, *tool.stats.values(), [{"label": a, "renamed": k} for a, k in tool.labels], list(known.items()), tool.domains, code.hashed(tool.hidden)))
                held += len(output or "")
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    narrow = df.select(F.col(session).cast("string").alias(session), F.col(number).cast("long").alias(number), body)
    return narrow.repartition(session).sortWithinPartitions(session, number, body).mapInArrow(run, f"{session} string, {number} long, {SCHEMA}")


def session_names(transformed: DataFrame, session: str) -> DataFrame:
    """(session, name, synthetic): all names of each session, a row for each."""
    return transformed.select(session, F.explode("mapping").alias("name", "synthetic")).distinct()


def stats(transformed: DataFrame, session: str) -> DataFrame:
    """Counters of a session's requests, added up, and the domains that they used."""
    sums = [F.sum(c).alias(c) for c in ("names", "comments", "strings", "constants")]
    return transformed.groupBy(session).agg(F.count(F.lit(1)).alias("requests"), *sums, F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("domains"))


def marker(method: str, path: str, status: str, names: str, ms: str):
    """A line of the exchange log; of a target only the path is shown."""
    return F.format_string("%s %s -> %d, %d names, %d ms", F.col(method), X.log_path(F.col(path)), F.col(status), F.col(names), F.col(ms))
