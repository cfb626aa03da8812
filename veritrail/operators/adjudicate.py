"""The optional model-based review: who is asked, and what the answers change. What is asked, and how, is in model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
# Verdicts and the status that each stands for; the second line are the names used in llm_verdicts.
VERDICTS = {
    "confirmed": L.CONFIRMED, "needs_review": L.REVIEW, "inconsistent": L.INCONSISTENT, "not_found": L.NOT_FOUND,
    "support": L.CONFIRMED, "partial": L.REVIEW, "conflict": L.INCONSISTENT, "contradict": L.INCONSISTENT, "absent": L.NOT_FOUND,
}
ANSWERS = "results array<struct<index:int,verdict:string,citation:string,reasoning:string,verifiable:string>>"


def with_evidence(claims: DataFrame, most: int = 3) -> DataFrame:
    """Adds evidence: the first candidates if there is such a column and it isn't empty, else the snippet."""
    entry = "array<struct<source:string,text:string>>"
    snippet = F.when(F.trim("snippet") != "", F.array(F.struct("source", F.col("snippet").alias("text")))).otherwise(F.array().cast(entry))
    snippet = F.coalesce(snippet, F.array().cast(entry)).cast(entry)
    if "candidates" in claims.columns:
        own = F.transform(F.slice("candidates", 1, most), lambda c: F.struct(c["source"].alias("source"), c["text"].alias("text")))
        snippet = F.when(F.size(F.coalesce("candidates", F.array())) > 0, own.cast(entry)).otherwise(snippet)
    return claims.withColumn("evidence", snippet)


def judge_queue(claims: DataFrame) -> DataFrame:
    """Claims for the judge: not found; to be reviewed, with evidence; confirmed with warnings, with evidence."""
    rows = with_evidence(claims)
    has = F.size("evidence") > 0
    warned = F.size(F.coalesce("warnings", F.array())) > 0
    return rows.filter(F.contains("status", F.lit("✗")) | F.contains("status", F.lit("需核实")) & has | F.contains("status", F.lit("✓")) & warned & has)


def classify_queue(claims: DataFrame) -> DataFrame:
    """Claims not found that have no label yet."""
    return claims.filter(F.contains("status", F.lit("✗")) & F.col("verifiable").isNull())


def repaired(answer: Column, schema: str = ANSWERS) -> Column:
    """Rows of a model's JSON answer: code fences go; if it still is no JSON, what lies between the first
    and the last brace or bracket counts; a bare list counts as the list of results."""
    body = F.regexp_replace(F.trim(answer), r"(?s)^```[a-zA-Z]*\n?|\n?```$", "")
    as_object = lambda text: F.from_json(F.when(F.trim(text).startswith("["), F.concat(F.lit('{"results":'), text, F.lit("}"))).otherwise(text), schema)["results"]
    inner = F.regexp_extract(body, r"(?s)[\[{].*[\]}]", 0)
    return F.coalesce(as_object(body), as_object(inner))


CLAIMS_ANSWER = "results array<struct<text:string,numbers:array<string>,entities:array<string>,kind:string>>"


def model_claims(answers: DataFrame, text_id: str) -> DataFrame:
    """text_id, part_no, answer -> text_id, claim_text, kind, numbers, entities: the claims that a model named
    in its answers on a text's parts, in their order, once each.

    Claims of fewer than six characters are left out, so are blank numbers and names; where the model
    names no numbers they are taken from the text. A text of which any part failed (null answer) has no rows
    here: it goes to the extraction without a model (offline_claims)."""
    failed = answers.filter("answer is null").select(text_id).distinct()
    body = F.regexp_replace(F.regexp_replace("answer", '"claims"', '"results"'), '"表述"', '"results"')
    for original, name in (("表述内容", "text"), ("命中数字", "numbers"), ("命中实体", "entities"), ("类型", "kind")):
        body = F.replace(body, F.lit(f'"{original}"'), F.lit(f'"{name}"'))
    rows = answers.join(failed, text_id, "left_anti").select(text_id, "part_no", F.posexplode(repaired(body, CLAIMS_ANSWER)).alias("at", "c"))
    text = T.trimmed(F.col("c.text"))
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.trimmed), lambda x: x != "")
    named = clean(F.col("c.numbers"))
    numbers = F.when(F.size(named) > 0, named).otherwise(T.numbers(text))
    rows = rows.filter(F.length(text) >= 6).select(text_id, "part_no", "at", text.alias("claim_text"), numbers.alias("numbers"), clean(F.col("c.entities")).alias("entities"), F.col("c.kind").alias("kind"))
    first = rows.groupBy(text_id, "claim_text").agg(F.min_by(F.struct("numbers", "entities", "kind"), F.struct("part_no", "at")).alias("f"))
    kind = F.coalesce(F.col("f.kind"), F.when(F.size("f.numbers") > 0, "定量").otherwise("定性"))
    return first.select(text_id, "claim_text", kind.alias("kind"), "f.numbers", "f.entities")


def apply_verdicts(claims: DataFrame, verdicts: DataFrame, queued: bool = False) -> DataFrame:
    """claims (claim_id, status, ..., snippet) and verdicts (claim_id, verdict, citation, reasoning,
    verifiable) -> claim_id, status, citation, reasoning, verifiable, note.

    A missing or unknown verdict leaves the status, with a note. A verdict changes the status only where
    there is evidence, so that a claim not found without any is but labelled; a reason becomes a note
    only if it speaks against the claim. Both sides have one row a claim. With `queued` the claims are those that were
    asked about, with their evidence; otherwise they are found by judge_queue."""
    answers = verdicts.select("claim_id", F.lit(True).alias("answered"), F.lower(F.trim("verdict")).alias("verdict"), F.trim("citation").alias("citation"), F.trim("reasoning").alias("reasoning"), "verifiable")
    rows = (claims if queued else judge_queue(claims)).select("claim_id", "status", F.size("evidence").alias("n_evidence")).join(answers, "claim_id", "left")
    known = F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair))
    meant = F.try_element_at(known, F.col("verdict"))
    kept = F.col("answered").isNull() | meant.isNull()
    speaks_against = meant.isin(L.REVIEW, L.INCONSISTENT) & (F.coalesce("reasoning", F.lit("")) != "")
    note = (
        F.when(F.col("answered").isNull(), "NO_ANSWER").when(meant.isNull(), F.concat(F.lit("UNKNOWN_VERDICT:"), F.coalesce("verdict", F.lit(""))))
        .when(speaks_against, F.concat(F.lit("LLM_NOTE:"), "reasoning"))
    )
    nonblank = lambda c: F.when(~kept & (F.col(c) != ""), F.col(c)).alias(c)
    return rows.select(
        "claim_id", F.when(~kept & (F.col("n_evidence") > 0), meant).otherwise(F.col("status")).alias("status"),
        nonblank("citation"), nonblank("reasoning"), F.when(~kept, F.col("verifiable")).alias("verifiable"), note.alias("note"),
    )


def prefilter(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims less those that the model says need no check; one without an answer stays.
    answers: claim_id, needs_check."""
    return claims.join(answers.filter(~F.col("needs_check")).select("claim_id"), "claim_id", "left_anti")
