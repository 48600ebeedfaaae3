"""Name mappings: numbering, compact and pooled names, aliases, expiry, capacity, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

#: Nouns and endings that pooled names are built from, by rule; pass another pool to use other words.
THEMES = ("Ledger", "Survey", "Harbor")
POOL_STEMS = {
    "function": ("resolve", "prepare", "collect", "arrange", "review"),
    "variable": ("first", "second", "current", "pending", "settled", "shared", "local", "outer"),
    "class": ("Store", "Reader", "Writer", "Planner"),
    "type": ("Shape", "Record", "Outline", "Status"),
    "property": ("count", "label", "state", "limit"),
    "string": ("message", "title", "caption"),
    "literal": ("open", "closed", "held", "due"),
}
CAPITAL_LAST = ("class", "type")


def pooled_names(kind: str, theme: int = 0) -> list[str]:
    """The pool of a kind under a theme: each stem with the theme's noun."""
    noun = THEMES[theme % len(THEMES)]
    return [f"{noun}{s}" if kind in CAPITAL_LAST else f"{s}{noun}" for s in POOL_STEMS[kind]]


def compact_name(kind: Column, n: Column) -> Column:
    prefix = F.create_map(*[x for k, v in P.KIND_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    return F.concat(F.element_at(prefix, kind), F.lit("_"), X.base36(n))


def pooled_name(kind: Column, n: Column, theme: int = 0) -> Column:
    """The n-th name of the kind's pool; past its end the names come again with a base-36 number."""
    out = None
    for k in POOL_STEMS:
        names = pooled_names(k, theme)
        at = F.pmod(n - 1, F.lit(len(names))).cast("int")
        cycle = F.floor((n - 1) / len(names))
        name = F.concat(F.get(F.array(*[F.lit(x) for x in names]), at), F.when(cycle == 0, "").otherwise(X.base36(cycle + 1)))
        out = F.when(kind == k, name) if out is None else out.when(kind == k, name)
    return out


def first_seen(names: DataFrame, session: str, kind: str, name: str, position: str) -> DataFrame:
    """Distinct names of each session and kind with a number in order of first sight. A session's names
    are numbered by one task; its capacity (10,000 entries by default) bounds them."""
    first = names.groupBy(session, kind, name).agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"))
    w = Window.partitionBy(session, kind).orderBy("first_pos", name)
    return first.withColumn("number", F.row_number().over(w).cast("long"))


def allocate(names: DataFrame, session: str, kind: str, name: str, position: str, style: str = "compact", forbidden: DataFrame | None = None, theme: int = 0) -> DataFrame:
    """Numbered names with ``synthetic``. A synthetic that a source already uses (``forbidden``: session,
    name) is marked and spelt with a trailing underscore, so none is ever met twice."""
    out = first_seen(names, session, kind, name, position)
    make = compact_name if style == "compact" else (lambda k, n: pooled_name(k, n, theme))
    out = out.withColumn("synthetic", make(F.col(kind), F.col("number")))
    taken = names.select(F.col(session), F.col(name).alias("synthetic")) if forbidden is None else forbidden.toDF(session, "synthetic")
    hit = taken.distinct().withColumn("is_taken", F.lit(True))
    out = out.join(hit, [session, "synthetic"], "left").withColumn("collides", F.coalesce("is_taken", F.lit(False)))
    return out.withColumn("synthetic", F.when(F.col("collides"), F.concat("synthetic", F.lit("_"))).otherwise(F.col("synthetic"))).drop("is_taken")


def lookup(df: DataFrame, mapping: DataFrame, column: str, source: str, target: str, out: str) -> DataFrame:
    """``df`` with the mapped value, or the value itself where the mapping has none."""
    m = mapping.select(F.col(source).alias(column), F.col(target).alias("__t"))
    return df.join(m, column, "left").withColumn(out, F.coalesce("__t", column)).drop("__t")


def register_exact(mapping: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (original, synthetic) pairs, each with ``accepted``: false if either side is taken by another."""
    by_original = mapping.select("original", F.col("synthetic").alias("has"))
    by_synthetic = mapping.select("synthetic", F.col("original").alias("held_by"))
    out = wanted.join(by_original, "original", "left").join(by_synthetic, "synthetic", "left")
    free = (F.col("has").isNull() | (F.col("has") == F.col("synthetic"))) & (F.col("held_by").isNull() | (F.col("held_by") == F.col("original")))
    return out.select("original", "synthetic", free.alias("accepted"))


def invert(mapping: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """value -> key; of several keys the later wins."""
    return mapping.groupBy(value).agg(F.max_by(key, position).alias(key))


def expired(df: DataFrame, last_used: str, now: Column, ttl_ms: int) -> DataFrame:
    """``is_expired``: idle for the time to live or longer."""
    idle = F.unix_millis(now) - F.unix_millis(F.col(last_used))
    return df.withColumn("idle_ms", idle).withColumn("is_expired", idle >= ttl_ms)


def within_capacity(df: DataFrame, session: str, inserted: str, tie: str, capacity: int) -> DataFrame:
    """The latest inserted ``capacity`` entries of each session; the oldest inserted go first."""
    w = Window.partitionBy(session).orderBy(F.desc(inserted), F.desc(tie))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= capacity).drop("__r")


def path_aliases(paths: DataFrame, session: str, path: str, position: str, directory: str | None = None) -> DataFrame:
    """Neutral aliases: ``source`` with the extension for files, ``workspace`` for folders; the second
    and later of one alias are numbered, by one task for each session, whose capacity bounds its paths."""
    first = paths.groupBy(session, path, *([directory] if directory else [])).agg(F.min(position).alias("first_pos"))
    ext = X.extension(F.col(path))
    is_dir = F.col(directory) if directory else F.lit(False)
    plain = is_dir & F.col(path).isin(".", "/", "")
    stem = F.when(is_dir, "workspace").otherwise("source")
    first = first.withColumn("__stem", stem).withColumn("__ext", F.when(is_dir, "").otherwise(ext)).filter(~plain)
    w = Window.partitionBy(session, "__stem", "__ext").orderBy("first_pos", path)
    n = F.row_number().over(w)
    alias = F.concat("__stem", F.when(n == 1, "").otherwise(F.concat(F.lit("_"), n.cast("string"))), "__ext")
    return first.withColumn("alias", alias).drop("__stem", "__ext")


def alias_paths(text: Column, pairs: Column) -> Column:
    """Known paths by their aliases, longest path first; ``pairs`` is array<struct<path,alias>>."""
    return X.replace_literals(text, pairs, "path", "alias")


def restore_paths(text: Column, pairs: Column) -> Column:
    """Aliases by their paths, longest alias first."""
    return X.replace_literals(text, pairs, "alias", "path")


def as_map(names: DataFrame, session: str) -> DataFrame:
    """Each session's whole mapping, synthetic to original, as one map."""
    return names.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("synthetic", "name")))).alias("mapping"))


def discovered_paths(text: Column) -> Column:
    """Distinct path-shaped tokens of a text: files and folders, no URLs."""
    files = F.regexp_extract_all(text, F.lit(P.PATH_FILE), F.lit(1))
    folders = F.regexp_extract_all(text, F.lit(P.PATH_DIR), F.lit(1))
    return F.filter(F.array_distinct(F.concat(files, folders)), lambda p: ~F.startswith(p, F.lit("//")) & ~F.contains(p, F.lit("://")))
