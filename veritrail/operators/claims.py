"""From target texts to claims, and from claims to what can be verified in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..session import materialize
from . import ordering
from .ordering import numbered


def category_words(words: DataFrame) -> list[str]:
    """The configured suffixes: a list made by people, of hundreds at most, that goes into one pattern."""
    return sorted(r[0] for r in words.select(F.trim("word")).filter("length(trim(word)) >= 2").distinct().collect())


def split_claims(texts: DataFrame, text_id: str) -> DataFrame:
    """text_id, text -> text_id, pos, claim_text: the sentences of more than ten characters that aren't
    mere numbering, once a text, by their first place."""
    parts = texts.select(text_id, F.posexplode(F.split("text", r"[。；\n]+")).alias("pos", "part"))
    parts = parts.select(text_id, "pos", T.trimmed(F.col("part")).alias("claim_text"))
    parts = parts.filter((F.length("claim_text") > L.CLAIM_OVER) & ~F.col("claim_text").rlike(r"(?U)^[\s\d\.、）\)]+$"))
    first = parts.groupBy(text_id, "claim_text").agg(F.min("pos").alias("pos"))
    return first.select(text_id, "pos", "claim_text")


def describe_claims(claims: DataFrame, pattern: str) -> DataFrame:
    """Adds kind, numbers, entities and sub_claims to claim_text."""
    text = F.col("claim_text")
    described = claims.withColumns({"numbers": T.numbers(text), "entities": T.entities(text, pattern), "sub_claims": T.clauses(text, pattern)})
    return described.withColumn("kind", F.when(F.size("numbers") > 0, "定量").otherwise("定性"))


def offline_claims(claims: DataFrame) -> DataFrame:
    """Described claims that have a number, a name or a verb of achievement."""
    return claims.filter((F.size("numbers") > 0) | (F.size("entities") > 0) | F.col("claim_text").rlike(T.any_of(L.GATE_VERBS)))


def prompt_texts(texts: DataFrame, text_id: str, most: int = 3500) -> DataFrame:
    """text_id, text -> text_id, part_no, part: paragraphs packed in order into parts of up to `most`
    characters; a longer paragraph is a part of its own."""
    paragraphs = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc, p):
        full = (acc["held"] != "") & (F.length(acc["held"]) + F.length(p) > most)
        closed = F.struct(F.concat(acc["done"], F.array(acc["held"])).alias("done"), p.alias("held"))
        joined = F.struct(acc["done"].alias("done"), F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit("\n"), p)).alias("held"))
        return F.when(full, closed).otherwise(joined)

    parts = F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))
    return texts.select(text_id, F.posexplode(parts).alias("part_no", "part"))


def conflicts(claims: DataFrame, similarity: float = L.ATTRIBUTE_SIMILARITY) -> DataFrame:
    """target_path, claim_id, claim_text, entities -> target_path, entity, claim_id, n, n_conflicts: claims of a target
    that share a name but few of the words around it (an off-by-default check).

    Claims with the same words around the name are one class and agree; a row stands for a class, with its least claim and
    its number of claims, and tells with how many claims of other classes it conflicts. Nearly all classes conflict, so those
    that don't are found, by a join on the rarest words of each that a pair of that similarity can't all lack, and taken off."""
    named = claims.select("target_path", "claim_id", "claim_text", F.explode(F.array_distinct("entities")).alias("entity"))
    words = F.array_sort(T.attribute_words(F.col("claim_text"), F.col("entity"))).alias("words")
    within = ["target_path", "entity"]
    classes = named.select("target_path", "claim_id", "entity", words).groupBy(*within, "words").agg(F.min("claim_id").alias("claim_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    totals = classes.groupBy(*within).agg(F.sum("n").alias("_total"))
    single = classes.select(*within, "claim_id", F.explode("words").alias("word"))
    held = single.groupBy(*within, "word").agg(F.count(F.lit(1)).alias("_held"))
    rare = single.join(held, [*within, "word"]).groupBy(*within, "claim_id").agg(F.array_sort(F.collect_list(F.struct("_held", "word"))).alias("_words"))
    keys = rare.select(*within, "claim_id", F.explode(F.slice("_words", F.lit(1), F.size("_words") - F.ceil(F.size("_words") * similarity).cast("int") + 1)).alias("_k")).select(*within, "claim_id", F.col("_k.word").alias("word"))
    met = keys.join(keys.withColumnRenamed("claim_id", "_other"), [*within, "word"]).filter("claim_id <> _other").select(*within, "claim_id", "_other").distinct()
    a = classes.select(*within, "claim_id", F.col("words").alias("_a"))
    b = classes.select(*within, F.col("claim_id").alias("_other"), F.col("words").alias("_b"), F.col("n").alias("_n"))
    value = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    agreeing = met.join(a, [*within, "claim_id"]).join(b, [*within, "_other"]).filter(value >= similarity).groupBy(*within, "claim_id").agg(F.sum("_n").alias("_agree"))
    rows = classes.select(*within, "claim_id", "n").join(totals, within).join(agreeing, [*within, "claim_id"], "left")
    rows = rows.select(*within, "claim_id", "n", (F.col("_total") - F.col("n") - F.coalesce("_agree", F.lit(0))).alias("n_conflicts"))
    return rows.filter("n_conflicts > 0")


def batches(items: DataFrame, order: str, size: int, within: str) -> DataFrame:
    """Adds batch_no and index (from 1) within a target, by order (a number)."""
    rows = numbered(items, [within], [order], "_n")
    return rows.withColumns({"batch_no": F.floor((F.col("_n") - 1) / size), "index": (F.col("_n") - 1) % size + 1}).drop("_n")


def neighbours(claims: DataFrame, within: str = "target_path") -> DataFrame:
    """Adds the claim text before and after, in the order of the target; empty at the ends."""
    return ordering.neighbours(claims, within, ["pos", "claim_id"], "claim_text")
