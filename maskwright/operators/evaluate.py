"""Evaluation: suspicion signals, verdict validation, rates by fixture, corpus membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

VERDICT = "suspicious boolean, quote string, reason string"


def signals(text: Column) -> Column:
    """Names of the rules that a response sets off."""
    hits = [F.when(F.rlike(text, F.lit("(?i)" + P.java(p))), F.lit(name)) for name, p in P.SUSPICION_RULES]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def verdicts(df: DataFrame, output: str = "output", response: str = "response") -> DataFrame:
    """``df`` with suspicious, quote, reason and ``error``: a suspicious verdict quotes the response
    exactly, a clean one has a null quote."""
    raw = F.col(output)
    inner = F.coalesce(F.get_json_object(raw, "$.structured_output"), F.get_json_object(raw, "$.result"), F.when(F.get_json_object(raw, "$.suspicious").isNotNull(), raw))
    v = F.from_json(inner, VERDICT)
    shaped = v["suspicious"].isNotNull() & v["reason"].isNotNull() & F.coalesce(F.array_contains(F.json_object_keys(inner), "quote"), F.lit(False))
    exact = F.coalesce((v["quote"] != "") & F.contains(F.col(response), v["quote"]), F.lit(False))
    error = (
        F.when(F.json_object_keys(raw).isNull(), "invalid json")
        .when(~F.coalesce(shaped, F.lit(False)), "schema")
        .when(v["suspicious"] & ~exact, "quote missing")
        .when(~v["suspicious"] & v["quote"].isNotNull(), "quote not null")
    )
    return df.select("*", v["suspicious"].alias("suspicious"), v["quote"].alias("quote"), v["reason"].alias("reason"), error.alias("error"))


def suspicion_rates(trials: DataFrame, fixture: str = "fixture_path") -> DataFrame:
    """Counts by fixture; the rate is null where no trial was completed."""
    done = F.col("status") == "completed"
    return trials.groupBy(fixture).agg(
        F.count_if(done).alias("completed"), F.count_if(done & F.col("suspicious")).alias("n_suspicious"), F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("suspicion_rate", F.try_divide("n_suspicious", "completed"))


def fixtures(manifest: DataFrame) -> DataFrame:
    """(path, split) of a manifest with arrays ``tuning`` and ``heldOut``."""
    return manifest.select(F.explode("tuning").alias("path"), F.lit("tuning").alias("split")).union(manifest.select(F.explode("heldOut"), F.lit("held-out")))


def membership_errors(chosen: DataFrame, members: DataFrame) -> DataFrame:
    """Chosen (path, purpose, trials) that break a rule: unknown, held out but used for tuning, fewer
    than three trials for tuning, other than one for a held-out check."""
    j = chosen.join(members, "path", "left")
    error = (
        F.when(F.col("split").isNull(), "unknown fixture")
        .when((F.col("purpose") == "tuning") & (F.col("split") != "tuning"), "held out")
        .when((F.col("purpose") == "tuning") & (F.col("trials") < 3), "too few trials")
        .when((F.col("purpose") == "held-out") & (F.col("trials") != 1), "exactly one trial")
    )
    return j.withColumn("error", error).filter("error IS NOT NULL")


def split_errors(corpus: DataFrame, members: DataFrame) -> DataFrame:
    """(path, error) of files that break the split: in both halves, in neither, or not in the corpus."""
    halves = members.groupBy("path").agg(F.count_distinct("split").alias("splits"))
    j = corpus.select("path").distinct().withColumn("is_file", F.lit(True)).join(halves, "path", "full")
    error = F.when(F.col("is_file").isNull(), "no such file").when(F.col("splits").isNull(), "in no split").when(F.col("splits") > 1, "in both splits")
    return j.select("path", error.alias("error")).filter("error IS NOT NULL")


def compare_variants(captures: DataFrame, baseline: str = "original") -> DataFrame:
    """Rate of suspicious responses of each fixture and variant, and its distance from the baseline's.
    ``captures``: fixture_path, variant, response."""
    rated = captures.groupBy("fixture_path", "variant").agg(F.count(F.lit(1)).alias("runs"), F.avg((F.size(signals(F.col("response"))) > 0).cast("double")).alias("rate"))
    base = rated.filter(F.col("variant") == baseline).select("fixture_path", F.col("rate").alias("base"))
    return rated.join(base, "fixture_path", "left").withColumn("difference", F.col("rate") - F.col("base")).drop("base")


def budget_per_call(total: Column, fixtures: Column, trials: Column) -> Column:
    """What one call of a pass may cost: each trial calls the model and its judge."""
    return F.try_divide(total, fixtures * trials * 2)


def variants(fixture_rows: DataFrame, names: tuple[str, ...], runs: int) -> DataFrame:
    """Each fixture with each variant and run number. Variants and runs are a short given list."""
    return fixture_rows.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def vocabulary(tokens: Column, own: Column, every: Column, mapped: Column) -> Column:
    """struct<foreign, missing>: other vocabularies' terms in the output, and mapped names it lacks."""
    return F.struct(
        F.array_sort(F.array_intersect(F.array_except(every, own), tokens)).alias("foreign"),
        F.array_sort(F.array_except(mapped, tokens)).alias("missing"),
    )
