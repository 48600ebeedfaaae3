"""Quality rules as a short-circuit cascade [native].

Each rule is a Boolean SQL expression that is true where a document is rejected. On a sample, the
cascade measures what a rule costs (seconds for the sample, beyond those of a rule that does nothing)
and how much it rejects, and orders the rules by rejection per cost. Each rule is a step of the plan: its
features are derived only where no rule before has rejected, so dear rules cost nothing for documents
that cheap ones turned away. The order changes the time alone; a document is kept exactly when no rule
rejects it. Features that the caller wants to keep are derived for every row first.

Defined results: a null or empty text has no words; rule ``few_words`` rejects it. Repeated rows
get equal verdicts. An empty table gives an empty result and the declared order. Extra columns
stay as they are; helper columns have the prefix ``__q_`` and are dropped.

Windows of five words are compared by a 64-bit hash inside one text; two different windows of a
text of 20,000 words share one with a chance of about 1e-11.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, WORD, read_table

WINDOW = 5
#: Rows of the sample that orders the rules, about; it decides nothing else.
SAMPLE_ROWS = 2000

#: Features a rule may name, in the order they are derived: SQL over the text and earlier features.
FEATURES: dict[str, str] = {
    "words": rf"array_remove(split(__q_text, r'{SPACE}', -1), '')",
    "n_words": "cast(size(__q_words) as bigint)",
    "word_chars": r"cast(length(translate(__q_text, ' \t\n' || char(11) || char(12) || char(13), '')) as bigint)",
    "n_symbols": "cast(length(__q_text) - length(translate(__q_text, '#*$%&|<>', '')) as bigint)",
    "n_marks": "cast(length(__q_text) - length(translate(__q_text, '!?', '')) as bigint)",
    "n_upper": r"cast(length(__q_text) - length(regexp_replace(__q_text, r'\p{Lu}', '')) as bigint)",
    "lines": r"filter(split(__q_text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')",
    "n_lines": "cast(size(__q_lines) as bigint)",
    "n_dup_lines": "cast(size(__q_lines) - size(array_distinct(__q_lines)) as bigint)",
    "windows": "CASE WHEN __q_n_words >= 5 THEN transform(slice(__q_words, 1, cast(__q_n_words as int) - 4), (w, i) -> "
    "xxhash64(w, __q_words[i + 1], __q_words[i + 2], __q_words[i + 3], __q_words[i + 4])) ELSE array() END",
    # only texts in which some window comes back go on to the sort
    "sorted_windows": "CASE WHEN size(array_distinct(__q_windows)) < size(__q_windows) THEN array_sort(transform(__q_windows, (h, i) -> struct(h, i))) END",
    "repeat_starts": "array_sort(transform(filter(__q_sorted_windows, (x, j) -> x.h = get(__q_sorted_windows, j - 1).h OR x.h = get(__q_sorted_windows, j + 1).h), x -> x.i))",
    "n_repeat_words": "coalesce(aggregate(transform(__q_repeat_starts, (p, k) -> coalesce(least(5, get(__q_repeat_starts, k + 1) - p), 5)), 0L, (a, x) -> a + x), 0L)",
    "n_stutter": "cast(size(filter(__q_words, (w, i) -> w = get(__q_words, i + 1))) as bigint)",
}


@dataclass(frozen=True)
class Rule:
    """``reject``: SQL that is true for rejected documents; ``{name}`` stands for a feature."""

    name: str
    reject: str

    def column(self) -> Column:
        return F.expr(self.reject.format(**{k: f"__q_{k}" for k in FEATURES}))


#: The base of the contract.
BASE_RULES = (
    Rule("few_words", "{n_words} < 10"),
    Rule("repeats", "100 * {n_repeat_words} > 20 * {n_words}"),
)
#: The rules of the cascade beyond the base.
RULES = (
    Rule("symbols", "10 * {n_symbols} > 2 * {n_words}"),
    Rule("marks", "10 * {n_marks} > 5 * {n_words}"),
    Rule("shouting", "{n_words} >= 10 AND 10 * {n_upper} > 6 * {word_chars}"),
    Rule("word_length", "{word_chars} > 40 * {n_words} OR 10 * {word_chars} < 15 * {n_words}"),
    Rule("dup_lines", "{n_lines} >= 4 AND 10 * {n_dup_lines} > 5 * {n_lines}"),
    Rule("stutter", "10 * {n_stutter} > 3 * {n_words}"),
)


def _needs(names: set[str]) -> list[str]:
    """The named features and those they are derived from, in order."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        if (name := todo.pop()) not in found:
            found.add(name)
            todo += [k for k in FEATURES if k != name and f"__q_{k}" in _tokens(FEATURES[name])]
    return [k for k in FEATURES if k in found]


def _tokens(sql: str) -> set[str]:
    out, word = set(), ""
    for c in sql + " ":
        if c.isalnum() or c == "_":
            word += c
        else:
            out.add(word)
            word = ""
    return out


def _used(rules: tuple[Rule, ...]) -> set[str]:
    return {k for k in FEATURES for r in rules if "{" + k + "}" in r.reject}


@dataclass(frozen=True)
class RuleCost:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[RuleCost]:
    """Cost and rejected share of each rule on a sample of about ``sample_rows`` rows drawn from all
    partitions, best rejection per cost first.

    The sample only orders the rules. Rules that reject nothing there come last, cheapest first.
    """
    total = df.count()
    if not total:
        return [RuleCost(r, 0.0, 0.0) for r in rules]
    sample = df.select(F.col(text_col).alias("t")).sample(min(1.0, sample_rows / total), seed=seed).cache()
    rows = max(1, sample.count())

    def timed(tested: tuple[Rule, ...]) -> tuple[float, int]:
        began = time.perf_counter()
        hits = cascade(sample, tested, "t").filter("__q_verdict IS NOT NULL").count()
        return time.perf_counter() - began, hits

    timed((Rule("warm_up", "false"),))
    idle, _ = timed((Rule("idle", "false"),))
    found = []
    for rule in rules:
        seconds, hits = timed((rule,))
        found.append(RuleCost(rule, max(seconds - idle, 1e-3) / rows, hits / rows))
    sample.unpersist()
    return sorted(found, key=lambda c: (-c.rank, c.seconds))


def cascade(df: DataFrame, rules: list[Rule] | tuple[Rule, ...], text_col: str = "text", keep_features: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``__q_verdict``, the name of the first rule that rejects or null, and with the features
    as ``__q_<name>``: those to keep in every row, others only where the verdict was open when a rule
    first needed them.

    A generator makes the last column: predicates on generated columns aren't pushed below, where the
    optimizer would copy every feature's expression into each use of it.
    """
    out = df.withColumn("__q_text", F.coalesce(F.col(text_col), F.lit("")))
    done = _needs(set(keep_features))
    for name in done:
        out = out.withColumn(f"__q_{name}", F.expr(FEATURES[name]))
    still = None
    for k, rule in enumerate(rules):
        for name in _needs(_used((rule,))):
            if name not in done:
                done.append(name)
                feature = F.expr(FEATURES[name])
                out = out.withColumn(f"__q_{name}", feature if still is None else F.when(still, feature))
        verdict = F.when(rule.column(), rule.name)
        out = out.withColumn(f"__q_verdict_{k}", verdict if still is None else F.when(still, verdict).otherwise(F.col(f"__q_verdict_{k - 1}")))
        still = F.isnull(f"__q_verdict_{k}")
    last = F.col(f"__q_verdict_{len(rules) - 1}") if rules else F.lit(None).cast("string")
    return out.select("*", F.inline(F.array(F.struct(last.alias("__q_verdict")))))


def judge(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text_col: str = "text", order: list[Rule] | None = None, keep_features: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``kept`` (no rule rejects) and the wanted features under their own names."""
    order = order if order is not None else [c.rule for c in measure(df, rules, text_col)]
    # a column that clashes with an output gives way
    names = [c for c in df.columns if c not in {"kept", *keep_features}]
    out = cascade(df, order, text_col, keep_features)
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"__q_{k}").alias(k) for k in keep_features], F.isnull("__q_verdict").alias("kept"))


def filter_documents(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """The documents that every rule lets through, with exactly the columns of ``df``."""
    order = order if order is not None else [c.rule for c in measure(df, rules, text_col)]
    return cascade(df, order, text_col).filter("__q_verdict IS NULL").select(*[F.col(f"`{c}`") for c in df.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of base and cascade for all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = judge(docs, BASE_RULES + RULES, keep_features=base)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return out.select("doc_id", *base, failed.alias("base_failed"), "kept")


_WORDS = rf"regexp_extract_all(t, '{WORD}')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
n AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
 (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
 len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
 coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))::BIGINT AS n_stutter
 FROM w LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 2 * n_words OR 10 * n_marks > 5 * n_words
 OR (n_words >= 10 AND 10 * n_upper > 6 * word_chars) OR word_chars > 40 * n_words OR 10 * word_chars < 15 * n_words
 OR (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines) OR 10 * n_stutter > 3 * n_words) AS kept
FROM f
"""
