"""Recall against annotated claims, and comparisons of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_status
from .containment import contains_join

LEAST_OVERLAP = 20


def match_gold(gold: DataFrame, results: DataFrame) -> DataFrame:
    """gold (item_id, claim_text), results (claim_id, claim_text) -> item_id, claim_id, overlap: the equal
    claim, else the one that holds the longest prefix (20 characters at least, spaces left out) of the
    item; the smallest claim_id on ties. Items without any are left out."""
    equal = gold.join(results, "claim_text").groupBy("item_id").agg(F.min("claim_id").alias("claim_id"), F.min(F.length("claim_text")).alias("overlap"))
    bare = F.replace("claim_text", F.lit(" "), F.lit(""))
    rest = gold.join(equal, "item_id", "left_anti").select("item_id", bare.alias("item")).filter(F.length("item") >= LEAST_OVERLAP)
    texts = results.select("claim_id", bare.alias("text"))
    heads = rest.select("item_id", "item", F.left("item", F.lit(LEAST_OVERLAP)).alias("term"))
    met = heads.join(contains_join(heads.select("term"), texts, "claim_id").select("term", "claim_id"), "term").join(texts, "claim_id")
    # a prefix stands in the text if a longer one does: halve the range between what fits and what doesn't, 32 steps at most
    span = F.struct(F.lit(LEAST_OVERLAP).alias("fits"), (F.least(F.length("item"), F.length("text")) + 1).alias("fails"))
    middle = lambda s: ((s["fits"] + s["fails"]) / 2).cast("int")
    halve = lambda s, _: F.when(s["fails"] - s["fits"] <= 1, s).when(F.contains(F.col("text"), F.left(F.col("item"), middle(s))), F.struct(middle(s).alias("fits"), s["fails"].alias("fails"))).otherwise(F.struct(s["fits"].alias("fits"), middle(s).alias("fails")))
    overlap = F.aggregate(F.sequence(F.lit(1), F.lit(32)), span, halve, lambda s: s["fits"])
    best = met.select("item_id", "claim_id", overlap.alias("overlap")).groupBy("item_id").agg(F.max(F.struct("overlap", (-F.col("claim_id")).alias("least"))).alias("b"))
    return equal.unionByName(best.select("item_id", (-F.col("b.least")).alias("claim_id"), "b.overlap"))


def score_gold(gold: DataFrame, results: DataFrame) -> DataFrame:
    """item_id, miss_type, test_set, expected, predicted, hit_1 (the status fits), hit_5 (or the expected
    source or passage turns up)."""
    matched = gold.join(match_gold(gold, results).select("item_id", "claim_id"), "item_id", "left").join(
        results.select("claim_id", F.col("status").alias("found_status"), F.col("source").alias("found_source"), F.col("snippet").alias("found_snippet")), "claim_id", "left"
    )
    expected = normal_status(F.col("expected_status"))
    predicted = F.when(F.col("claim_id").isNull(), "not_found").otherwise(normal_status(F.coalesce("found_status", F.lit(""))))
    stem = F.left(F.regexp_replace(F.regexp_extract(F.col("expected_source.source_path"), r"[^/]*$", 0), r"(?<=.)\.[^.]*$", ""), F.lit(20))
    head = F.left(F.col("expected_source.snippet"), F.lit(20))
    within = lambda part, whole: F.coalesce((part != "") & F.contains(whole, part), F.lit(False))
    hit = expected == predicted
    hit5 = hit | within(stem, F.col("found_source")) | within(head, F.col("found_snippet"))
    return matched.select("item_id", "miss_type", "test_set", expected.alias("expected"), predicted.alias("predicted"), hit.alias("hit_1"), hit5.alias("hit_5"))


def recall(scored: DataFrame, *by: str) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("hit", "recall"))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), share("hit_1"), share("hit_5"))


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n_items"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """value_a, value_b, n over the keys of either run; `?` where a run has none."""
    both = a.select(key, F.col(value).alias("value_a")).join(b.select(key, F.col(value).alias("value_b")), key, "full")
    return both.fillna("?", ["value_a", "value_b"]).groupBy("value_a", "value_b").agg(F.count(F.lit(1)).alias("n"))


def lost_items(items: DataFrame, kept: DataFrame) -> DataFrame:
    """items (item_id, claim_text) that neither stand in a kept text (text_id, text) nor hold one."""
    terms = items.select(F.col("claim_text").alias("term"))
    held = contains_join(terms, kept, "text_id").select(F.col("term").alias("claim_text")).distinct()
    holding = contains_join(kept.select(F.col("text").alias("term")), items.select("item_id", F.col("claim_text").alias("text")), "item_id").select("item_id").distinct()
    return items.join(held, "claim_text", "left_anti").join(holding, "item_id", "left_anti")
