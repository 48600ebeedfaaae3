"""Entities in text: detection, minting of tokens, replacement and exact restoration.

Detection is heuristic and no privacy boundary. Offsets and lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..sources.staging import staged
from .numbering import numbered

TYPES = ("PERSON", "ORGANIZATION", "EMAIL", "PHONE", "SSN", "MONEY")


#: What a text must hold for a pattern to match at all.
_SIGNS = {"EMAIL": lambda text: F.contains(text, F.lit("@")), "MONEY": lambda text: F.contains(text, F.lit("$"))}


def _may_hold(text: Column, kind: str) -> Column:
    return _SIGNS.get(kind, lambda t: F.rlike(t, F.lit("[0-9]{3}")))(text)


def regex_spans(text: Column, types: tuple[str, ...] = tuple(P.ENTITY_PATTERNS)) -> Column:
    """Spans of the entity patterns, one pattern after the other; a text without a pattern's sign isn't searched."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,type:string>>")
    return F.concat(*[F.when(text.isNull() | _may_hold(text, t), X.find_spans(text, P.ENTITY_PATTERNS[t], t)).otherwise(none) for t in types])


def entity_counts(text: Column) -> Column:
    """array<struct<type,n>>: how often each pattern matches."""
    found = [F.when(text.isNull() | _may_hold(text, t), F.regexp_count(text, F.lit(P.java(p)))).otherwise(0) for t, p in P.ENTITY_PATTERNS.items()]
    return F.array(*[F.struct(F.lit(t).alias("type"), n.alias("n")) for t, n in zip(P.ENTITY_PATTERNS, found, strict=True)])


def restore_html(page: Column, pairs: Column) -> Column:
    """Tokens back to reals in a page's text, never inside a tag."""
    parts = F.regexp_extract_all(page, F.lit("(<[^>]*>|<[^>]*$|[^<]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit("<")), x).otherwise(restore_tokens(x, pairs))), "")


def name_spans(text: Column, exact: bool = False) -> Column:
    """Likely names of persons and organizations: runs of capitalized words.

    Leading stopwords go while more than one word is left; acronyms go; a single word stays only if
    it is a known organization. Names are listed as if a single space stood between their words; with
    ``exact`` bounds and value are those of the text.
    """
    stop = F.array(*[F.lit(w) for w in P.STOPWORDS])
    known = F.array(*[F.lit(w) for w in P.KNOWN_ORGS])
    suffixes = F.array(*[F.lit(w) for w in P.ORG_SUFFIXES])

    def stripped(s: Column) -> Column:
        words = F.split(s["value"], r"\s+")
        zero = F.struct(F.lit(False).alias("done"), F.lit(0).alias("n"), F.lit(0).alias("shift"), s["value"].alias("rest"))

        def step(acc: Column, w: Column) -> Column:
            go = ~acc["done"] & (acc["n"] < F.size(words) - 1) & F.array_contains(stop, w)
            rest = F.regexp_replace(acc["rest"], r"^\S+\s+", "")
            return F.when(go, F.struct(F.lit(False).alias("done"), (acc["n"] + 1).alias("n"), (acc["shift"] + F.length(w) + 1).alias("shift"), rest.alias("rest"))).otherwise(
                F.struct(F.lit(True).alias("done"), acc["n"].alias("n"), acc["shift"].alias("shift"), acc["rest"].alias("rest"))
            )

        head = F.aggregate(words, zero, step)
        kept = F.slice(words, head["n"] + 1, F.size(words))
        phrase = F.array_join(kept, " ")
        start = s["start"] + head["shift"]
        own = (s["end"] - F.length(head["rest"]), s["end"], head["rest"]) if exact else (start, start + F.length(phrase), phrase)
        return F.struct(own[0].alias("start"), own[1].alias("end"), own[2].alias("value"), phrase.alias("phrase"), F.size(kept).alias("n"))

    # a single word loses nothing and stays only if it is known: most phrases end here
    likely = F.filter(X.find_spans(text, P.CAPITALIZED), lambda s: F.rlike(s["value"], F.lit(r"\s")) | F.array_contains(known, s["value"]))
    found = F.transform(likely, stripped)
    named = F.filter(found, lambda s: ~F.rlike(s["phrase"], F.lit(P.ACRONYM)) & ((s["n"] > 1) | F.array_contains(known, s["phrase"])))

    def classed(s: Column) -> Column:
        last = F.regexp_replace(F.element_at(F.split(s["phrase"], " "), -1), r"\.$", "")
        org = F.array_contains(suffixes, last) | ((s["n"] == 1) & F.array_contains(known, s["phrase"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.when(org, "ORGANIZATION").otherwise("PERSON").alias("type"))

    return F.transform(named, classed)


def all_spans(text: Column) -> Column:
    """Pattern spans, names that overlap none of them, and of all these the leftmost-longest."""
    regex = regex_spans(text)
    names = F.filter(name_spans(text, exact=True), lambda s: ~F.exists(regex, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    return X.resolve_overlaps(F.concat(regex, names))


def with_spans(df: DataFrame, text: str = "text", spans: Column | None = None) -> DataFrame:
    """``df`` with the column ``spans``. Each step is a column of its own, so patterns run once."""
    if spans is not None:
        return df.withColumn("spans", spans)
    out = df.withColumn("__regex", regex_spans(F.col(text))).withColumn("__names", name_spans(F.col(text), exact=True))
    names = F.filter("__names", lambda s: ~F.exists(F.col("__regex"), lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    return out.withColumn("spans", X.resolve_overlaps(F.concat("__regex", names))).drop("__regex", "__names")


def span_rows(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """A row for each span: the key, its place, bounds, value and type."""
    return df.select(key, F.posexplode(spans).alias("pos", "s")).select(key, "pos", "s.start", "s.end", "s.value", "s.type")


def spelled(kind: Column, value: Column) -> Column:
    """The value of an entity; a name is one whatever white space stands between its words."""
    return F.when(kind.isin("PERSON", "ORGANIZATION"), F.regexp_replace(value, r"\s+", " ")).otherwise(value)


def entity_key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(spelled(kind, value))))


def mint(spans: DataFrame, key: str) -> DataFrame:
    """The mapping table: entity_key, type, real, token and number, one row for each distinct entity.

    Numbers run by type in the order of texts, and inside a text from right to left. Only distinct
    values are numbered. Amounts are shifted instead of numbered. Where two amounts share a token,
    ``is_ambiguous`` says so, and that token isn't restored without provenance.
    """
    first = spans.groupBy(entity_key(F.col("type"), F.col("value")).alias("entity_key"), "type").agg(F.min(F.struct(F.col(key), -F.col("start"), F.col("value"))).alias("f"))
    flat = first.select("entity_key", "type", F.col("f")[key].alias("first_key"), F.col("f.col2").alias("back"), spelled(F.col("type"), F.col("f.value")).alias("real"))
    ordered = numbered(flat, "type", "first_key", "back", "entity_key", column="__n")
    starts = ordered.groupBy("type").agg(F.min("__n").alias("__s"))  # a row for each type
    out = ordered.join(F.broadcast(starts), "type").withColumn("number", F.col("__n") - F.col("__s") + 1)
    token = minted(F.col("type"), F.col("number"), F.col("real"))
    out = out.select("entity_key", "type", "real", "number", token.alias("token"))
    shared = out.groupBy("token").agg((F.count(F.lit(1)) > 1).alias("is_ambiguous"))
    return out.join(shared, "token").select("entity_key", "type", "real", "number", "token", "is_ambiguous")


def minted(kind: Column, n: Column, real: Column) -> Column:
    """The token of the n-th entity of a type."""
    letters = F.array(*[F.lit(x) for x in P.GREEK])
    cycle = F.floor((n - 1) / len(P.GREEK))
    person = F.concat(F.lit("Candidate_"), F.get(letters, F.pmod(n - 1, F.lit(len(P.GREEK))).cast("int")), F.when(cycle == 0, "").otherwise((cycle + 1).cast("string")))
    return (
        F.when(kind == "PERSON", person)
        .when(kind == "ORGANIZATION", F.concat(F.lit("Company_"), n.cast("string")))
        .when(kind == "EMAIL", F.concat(F.lit("redacted.contact"), n.cast("string"), F.lit("@example.com")))
        .when(kind == "PHONE", F.concat(F.lit("555-01"), F.format_string("%02d", n)))
        .when(kind == "SSN", F.concat(F.lit("000-00-"), F.format_string("%04d", n)))
        .when(kind == "MONEY", X.shift_money(real))
    )


def anonymize(df: DataFrame, key: str, text: str = "text", spans: Column | None = None, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sanitized texts and the mapping.

    The first frame has the columns of ``df``, ``sanitized_text``, ``n_redactions`` and ``spans`` with
    original and replacement of every occurrence, which make the restoration exact. Spans that are
    tokens of a given mapping are left alone, so a second pass changes nothing.
    """
    rows = staged(span_rows(with_spans(df.select(key, text), text, spans), key), "spans")  # patterns run once
    if mapping is not None:
        rows = rows.join(mapping.select(F.col("token").alias("value"), "type").distinct(), ["value", "type"], "left_anti")
    fresh = mint(rows, key)
    named = rows.withColumn("entity_key", entity_key(F.col("type"), F.col("value"))).join(fresh.select("entity_key", "token"), "entity_key")
    folded = named.groupBy(key).agg(F.collect_list(F.struct("start", "end", "value", "type", F.col("token").alias("replacement"))).alias("__found"))
    out = df.join(folded, key, "left").withColumn("spans", F.array_sort(F.coalesce("__found", F.array().cast("array<struct<start:int,end:int,value:string,type:string,replacement:string>>"))))
    return out.withColumn("sanitized_text", X.splice(F.col(text), F.col("spans"))).withColumn("n_redactions", F.size("spans").cast("long")).drop("__found"), fresh


def restore_exact(df: DataFrame, text: str = "sanitized_text", spans: str = "spans") -> Column:
    """The original of a sanitized text from its own spans."""
    zero = F.struct(F.lit(0).alias("shift"), F.filter(F.col(spans), lambda _: F.lit(False)).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = s["start"] + acc["shift"]
        end = start + F.length(s["replacement"])
        placed = F.struct(start.alias("start"), end.alias("end"), s["replacement"].alias("value"), s["type"].alias("type"), s["value"].alias("replacement"))
        return F.struct((acc["shift"] + F.length(s["replacement"]) - (s["end"] - s["start"])).alias("shift"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return X.splice(F.col(text), F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["out"]))


def restore_tokens(text: Column, pairs: Column) -> Column:
    """Tokens back to reals by literal replacement, longest token first; ``pairs`` is array<struct<token,real>>."""
    return X.replace_literals(text, pairs, "token", "real")
