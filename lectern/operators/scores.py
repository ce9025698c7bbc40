"""Quality of retrieval, of answers and of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edits import text_metrics

#: Groups of fixtures by tags; a fixture may be in several.
ROUTES = {"latin": ("printed",), "header": ("printed", "header"), "degraded": ("degraded",), "mixed": ("mixed",), "arabic": ("ara",)}
#: Ranges of values in which medians are looked for.
RANGES = 4096


def retrieval(outcome: DataFrame, key: str) -> DataFrame:
    """Per question: ``recall`` (1 if nothing is expected), rank of each expected source (0 where it
    is missing), ``irrelevant`` ones and whether those displaced an expected one. Null lists are
    empty."""
    empty = F.array().cast("array<string>")
    want, got = F.array_distinct(F.coalesce("expected", empty)), F.coalesce("retrieved", empty)
    hit = F.size(F.array_intersect(want, got))
    recall = F.when(F.size(want) == 0, 1.0).otherwise(hit / F.size(want))
    return outcome.select(
        key,
        F.round(recall, 6).alias("recall"),
        F.transform(want, lambda s: F.coalesce(F.array_position(got, s), F.lit(0)).cast("int")).alias("ranks"),
        F.size(F.array_except(got, want)).alias("irrelevant"),
        ((hit < F.size(want)) & (F.size(F.array_except(got, want)) > 0)).alias("displaced"),
    )


def answers(rows: DataFrame, key: str) -> DataFrame:
    """Completeness and honesty of answers.

    ``rows`` has ``answer``, ``facts`` (array of id and terms), ``forbidden``, ``expected_contradiction``,
    ``accept_insufficient``, ``contradictions`` and ``insufficient`` (counts). A fact counts if all its
    terms stand in the answer, in any case. A forbidden claim takes a quarter off and makes the answer
    dishonest, as does a contradiction passed over, or an empty answer where none is acceptable.
    """
    text = F.lower(F.coalesce("answer", F.lit("")))
    has = lambda t: F.contains(text, F.lower(t))
    facts = F.coalesce("facts", F.expr("cast(array() as array<struct<id:string,terms:array<string>>>)"))
    met = F.size(F.filter(facts, lambda f: F.forall(f["terms"], has)))
    bad = F.size(F.filter(F.coalesce("forbidden", F.array().cast("array<string>")), has))
    share = F.when(F.size(facts) == 0, 1.0).otherwise(met / F.size(facts))
    complete = F.greatest(F.lit(0.0), share - F.when(bad > 0, 0.25).otherwise(0.0))
    told = ~F.coalesce("expected_contradiction", F.lit(False)) | (F.col("contradictions") > 0)
    silent = (text == "") & ~F.coalesce("accept_insufficient", F.lit(False))
    return rows.select(key, F.size(facts).alias("facts"), met.alias("facts_met"), bad.alias("forbidden_claims"), F.round(complete, 6).alias("completeness"), ((bad == 0) & told & ~silent).alias("honest"), told.alias("contradiction_handled"))


def failure(recall: Column, citations_ok: Column, completeness: Column, honest: Column) -> Column:
    """The first of the failures, in this order."""
    return F.when(recall < 1, "query construction").when(~citations_ok, "citation").when(completeness < 1, "incomplete answer").when(~honest, "dishonest answer").otherwise("none")


def upper_medians(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The element at n/2 of each group's sorted values, counted from 0; groups of nulls have none.

    Values are counted first, so what is ranked is each different value once; the ranks are sums over
    parts of ``RANGES`` ranges of values, so no group is one task however many rows it has.
    """
    # a group is known by its columns as JSON, so that a null is a group of its own
    rows = rows.where(F.col(value).isNotNull()).withColumn("group", F.to_json(F.struct(*by)))
    seen = rows.groupBy("group", value).agg(F.count("*").alias("c"), *(F.first(b).alias(b) for b in by))
    edges = seen.groupBy("group").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("n"))
    width = F.greatest((F.col("high") - F.col("low")) / RANGES, F.lit(1e-9))
    placed = seen.join(edges, "group").withColumn("range", F.least(F.floor((F.col(value) - F.col("low")) / width), F.lit(RANGES - 1)).cast("int"))
    ranges = placed.groupBy("group", "range").agg(F.sum("c").alias("in_range"), F.first("n").alias("n"))
    # at most ``RANGES`` rows a group: which range holds the middle, and how many lie before it
    before = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    middle = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).withColumn("at", F.floor(F.col("n") / 2))
    middle = middle.where((F.col("before") <= F.col("at")) & (F.col("before") + F.col("in_range") > F.col("at"))).select("group", "range", "before", "at")
    upto = W.partitionBy("group").orderBy(value)
    ranked = placed.join(middle, ["group", "range"]).withColumn("upto", F.col("before") + F.sum("c").over(upto))
    # the first value whose rank passes the middle
    found = ranked.where(F.col("upto") > F.col("at")).groupBy("group").agg(*(F.first(b).alias(b) for b in by), F.min(value).alias("upper_median"), F.first("n").alias("n"))
    return found.drop("group")


def mode_first(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"), F.min(order).alias("seen"))
    return counted.groupBy(*by).agg(F.max("c").alias("n"), F.max_by(value, F.struct("c", (-F.unix_micros("seen")).alias("s"), value)).alias("mode"))


def recognition(pairs: DataFrame, key: str, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Error rates and edit counts of recognised texts; a null text counts as empty."""
    m = text_metrics(F.col(reference), F.col(hypothesis))
    others = [c for c in pairs.columns if c not in (reference, hypothesis, key)]
    return pairs.select(key, *others, m.alias("m")).select(key, *others, "m.*")


def micro(runs: DataFrame, *by: str) -> DataFrame:
    """Micro averages: errors over counts, never divided by less than 1."""
    total = lambda c: sum(F.col(f"{c}.{k}") for k in ("substitutions", "deletions", "insertions"))
    ratio = lambda a, b: F.round(F.sum(a) / F.greatest(F.lit(1), F.sum(b)), 6)
    return runs.groupBy(*by).agg(
        F.count("*").alias("fixtures"),
        ratio(total("character_edits"), F.col("characters")).alias("cer"),
        ratio(total("word_edits"), F.col("words")).alias("wer"),
        ratio(F.col("line_edits"), F.col("lines")).alias("line_error_rate"),
        ratio(F.col("punctuation_accuracy") * F.col("punctuation"), F.col("punctuation")).alias("punctuation_accuracy"),
        ratio(F.col("numeral_accuracy") * F.col("numerals"), F.col("numerals")).alias("numeral_accuracy"),
        F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 6).alias("elapsed"),
        F.max("peak_rss").alias("peak_rss"),
    )


def ranked(candidates: DataFrame, key: str, succeeded: Column) -> DataFrame:
    """``place`` among the candidates that succeeded, by error rates, time and id; others keep null."""
    w = W.orderBy("cer", "wer", "line_error_rate", "elapsed", key)
    good = candidates.where(succeeded).select(key, "cer", "wer", "line_error_rate", "elapsed").withColumn("place", F.row_number().over(w)).select(key, "place")
    return candidates.join(good, key, "left")


def routes(runs: DataFrame) -> DataFrame:
    """Runs with each route whose tags they all have."""
    names = F.array(*[F.struct(F.lit(n).alias("route"), F.array(*map(F.lit, t)).alias("need")) for n, t in ROUTES.items()])
    fit = F.filter(names, lambda r: F.size(F.array_except(r["need"], F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return runs.withColumn("r", F.explode(fit)).withColumn("route", F.col("r.route")).drop("r")
