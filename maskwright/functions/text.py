"""Column functions over text, numbers and time. All are built-in expressions; none calls Python for a row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def find_spans(text: Column, pattern: str, kind: str | None = None) -> Column:
    """All matches as array<struct<start,end,value[,type]>>: ``start`` counts code points from 0.

    Spark's extraction has no offsets, so the gaps between matches are kept by a split on the same
    pattern and lengths are summed in one fold.
    """
    regex = P.java(pattern)
    matches = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))
    gaps = F.split(text, regex, -1)
    # a gap and the match after it travel together: a lambda that named the arrays would split the
    # text anew for every match
    pairs = F.zip_with(gaps, matches, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        found = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.when(p["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(found)).alias("spans")))

    spans = F.aggregate(pairs, zero, step, lambda acc: acc["spans"])
    if kind is None:
        return spans
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("type")))


def resolve_overlaps(spans: Column) -> Column:
    """Leftmost-longest: by start, then longer first; a span that overlaps an accepted one is dropped."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])),
    )
    zero = F.struct(F.lit(-1).alias("last"), F.filter(ordered, lambda _: F.lit(False)).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

    return F.aggregate(ordered, zero, step, lambda acc: acc["kept"])


def splice(text: Column, spans: Column) -> Column:
    """``text`` with each span's ``replacement`` put in its place; spans don't overlap."""
    ordered = F.array_sort(spans, lambda a, b: b["start"] - a["start"])
    return F.aggregate(ordered, text, lambda acc, s: F.concat(acc.substr(F.lit(1), s["start"]), s["replacement"], acc.substr(s["end"] + 1, F.length(acc))))


def replace_literals(text: Column, pairs: Column, source: str, target: str) -> Column:
    """Every literal occurrence of ``source`` by ``target``, longest source first."""
    ordered = F.array_sort(pairs, lambda a, b: F.length(b[source]) - F.length(a[source]))
    return F.aggregate(ordered, text, lambda acc, p: F.replace(acc, p[source], p[target]))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def truncate(text: Column, most: int = P.LABEL_MOST) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def capitalize(text: Column) -> Column:
    """The first letter upper-cased, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[A-Za-z0-9]+$", 0)


def dirname(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(found == "", F.lit("/")).otherwise(found)


def replace_words(text: Column, mapping: dict[str, str]) -> Column:
    """Every word of ``mapping`` by its value, in one pass: an alternation, longest word first, that is
    bounded by ASCII letters, digits and underscore. Matches and the gaps between them are joined again."""
    if not mapping:
        return text
    words = "|".join(re.escape(w) for w in sorted(mapping, key=lambda w: (-len(w), w)))
    regex = rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
    to = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))
    pieces = F.zip_with(F.split(text, regex, -1), found, lambda gap, w: F.concat(gap, F.coalesce(F.element_at(to, w), F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))


def url_display(url: Column) -> Column:
    """Origin and path of a URL, without user, query and fragment; what is no URL gives a fixed text."""
    parts = [F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@]+)([^?#]*)", i) for i in (1, 2, 3)]
    return F.when(parts[1] == "", "[invalid URL]").otherwise(F.concat(F.lower(parts[0]), F.lit("://"), F.lower(parts[1]), F.when(parts[2] == "", "/").otherwise(parts[2])))


def log_path(target: Column) -> Column:
    """The path of a request's target, fit for a log: no host, query or fragment."""
    return F.regexp_replace(F.regexp_replace(target, r"^(?i:https?:)?//[^/]*", ""), r"[?#].*$", "")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + noun), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def fingerprint(text: Column) -> Column:
    """(h * 31 + code point) mod 1,000,003 over the characters, from 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * P.FINGERPRINT_BASE + F.ascii(c)) % P.FINGERPRINT_MODULUS)


def pseudonymous_label(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 16))


def round_half_up(x: Column) -> Column:
    """As JavaScript rounds: half towards plus infinity."""
    return F.floor(x + 0.5)


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(round_half_up(F.lit(100.0) * part / total).cast("long"))


def parse_amount(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def unit_interval(seed: Column) -> Column:
    x = F.sin(seed) * 10000
    return x - F.floor(x)


def shift_money(text: Column) -> Column:
    """A dollar amount moved by a seeded 15 per cent at most and rounded to its magnitude; 0 stays."""
    n = parse_amount(text)
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(n)))
    rounded = round_half_up(n * (F.lit(0.85) + unit_interval(n) * 0.3) / magnitude) * magnitude
    shifted = F.when(rounded == n, rounded + magnitude).otherwise(rounded)
    cents = F.rlike(text, F.lit(P.java(r"\.\d{2}\b")))
    shown = F.when(cents, F.format_number(shifted, 2)).otherwise(F.format_number(shifted, 0))
    return F.when(n.isNull() | (n == 0), text).otherwise(F.concat(F.lit("$"), shown))


def day(ts: Column) -> Column:
    """The UTC day of an ISO string: its first ten characters."""
    return F.substring(ts, 1, 10)


def iso(ts: Column) -> Column:
    """A timestamp as an ISO string with milliseconds."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, h:mm a 'UTC'")


def comment_placeholder(original: Column, ordinal: Column, style: str) -> Column:
    """A phrase for a comment, chosen by its length, fingerprint and place; newlines are kept."""
    block = ~F.startswith(original, F.lit("//"))
    size = F.length(original) - F.when(block, 4).otherwise(2)
    pools = {b: F.array(*[F.lit(x) for x in P.PHRASES[style, b]]) for b in ("short", "medium", "long")}
    at = F.pmod(fingerprint(original) + ordinal, F.lit(5)).cast("int")
    phrase = F.when(size <= P.SHORT_MOST, F.get(pools["short"], at)).when(size <= P.MEDIUM_MOST, F.get(pools["medium"], at)).otherwise(F.get(pools["long"], at))
    breaks = line_count(original) - 1
    return (
        F.when(~block, F.concat(F.lit("// "), phrase))
        .when(breaks == 0, F.concat(F.lit("/* "), phrase, F.lit(" */")))
        .otherwise(F.concat(F.lit("/* "), phrase, F.repeat(F.lit("\n"), (breaks - 1).cast("int")), F.lit("\n*/")))
    )


def redactable(text: Column) -> Column:
    """Long prose of at least two words that isn't a machine token."""
    several = F.size(F.filter(F.split(text, "[ _]+"), lambda w: w != "")) >= 2
    return (F.length(text) >= P.MIN_STRING) & ~F.rlike(text, F.lit(P.MACHINE_TOKEN)) & several


def strip_line_numbers(text: Column) -> Column:
    """struct<source, prefixes> if every one of at least two lines has a number one above the last; else null."""
    lines = F.split(text, "\n", -1)
    prefixes = F.transform(lines, lambda x: F.regexp_extract(x, P.LINE_PREFIX, 0))
    numbers = F.transform(prefixes, lambda x: F.trim(F.replace(F.replace(x, F.lit("\t"), F.lit("")), F.lit("\n"), F.lit(""))).try_cast("long"))
    steady = F.forall(F.sequence(F.lit(1), F.size(numbers) - 1), lambda i: F.get(numbers, i) == F.get(numbers, i - 1) + 1)
    whole = (F.size(lines) >= 2) & F.forall(prefixes, lambda x: x != "")
    rest = F.array_join(F.zip_with(lines, prefixes, lambda x, p: x.substr(F.length(p) + 1, F.length(x))), "\n")
    return F.when(whole, F.when(steady, F.struct(rest.alias("source"), prefixes.alias("prefixes"))))


def restore_line_numbers(source: Column, prefixes: Column) -> Column:
    """Prefixes put back; null if the number of lines has changed."""
    lines = F.split(source, "\n", -1)
    return F.when(F.size(lines) == F.size(prefixes), F.array_join(F.zip_with(lines, prefixes, lambda x, p: F.concat(p, x)), "\n"))
