"""The whole check, from folders to reports: claims of target texts against a folder of reference texts."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, claims, evaluate, model, report, retrieval, verify
from ..session import materialize
from ..sources import files
from ..sources.workbook import write_workbook

#: What a checked claim is stored as.
CHECKED = (
    "claim_id bigint, target_path string, pos int, kind string, claim_text string, status string, source string, snippet string, matched_keyword string, context_brief string, numbers array<string>, "
    "entities array<string>, sub_claims array<struct<text:string,independent:boolean,numbers:array<string>,entities:array<string>>>, warnings array<struct<code:string,detail:string>>, "
    "candidates array<struct<source:string,text:string,score:double>>, verifiable boolean, citation string, reasoning string"
)


@dataclass(frozen=True)
class Options:
    """retrieve: evidence from ranked chunks first. conflicts: also the check within a target (off by default, for it warns
    often). date: of the report, today if none is given."""

    retrieve: bool = True
    conflicts: bool = False
    words: str | None = None
    date: str | None = None
    doc: Callable[[bytes], str] | None = None


def reference_chunks(texts: DataFrame) -> DataFrame:
    """path, source, text -> chunk_id, source_path, source, chunk_offset, text."""
    keyed = texts.withColumn("ref_id", F.xxhash64("path"))
    cut = chunking.chunk_texts(keyed.select("ref_id", "text"), "ref_id").join(keyed.select("ref_id", "path", "source"), "ref_id")
    return cut.select(F.xxhash64("ref_id", "chunk_no").alias("chunk_id"), F.col("path").alias("source_path"), "source", F.col("offset").alias("chunk_offset"), "text")


def claims_of(targets: DataFrame, words: DataFrame, extractor: model.Client | None = None) -> DataFrame:
    """path, text -> the described claims, with claim_id. With an extractor the model names them; texts that it fails on,
    and all without it, are split by the rules."""
    pattern = T.category_pattern(claims.category_words(words))
    split = claims.describe_claims(claims.split_claims(targets.select(F.col("path").alias("target_path"), "text"), "target_path"), pattern)
    if extractor is not None:
        named = model.extract(targets.select(F.col("path").alias("target_path"), "text"), "target_path", extractor)
        named = named.join(targets.select(F.col("path").alias("target_path"), "text"), "target_path").withColumn("pos", F.instr("text", F.col("claim_text"))).drop("text")
        named = materialize(named.withColumn("sub_claims", T.clauses(F.col("claim_text"), pattern)), "named")
        gated = claims.offline_claims(split).join(named.select("target_path").distinct(), "target_path", "left_anti")
        split = named.unionByName(gated.select(*named.columns))
    return split.withColumn("claim_id", F.xxhash64("target_path", "claim_text"))


def check(targets: DataFrame, references: DataFrame, words: DataFrame, options: Options = Options(), extractor: model.Client | None = None, judge: model.Client | None = None, classifier: model.Client | None = None) -> DataFrame:
    """targets (path, text), references (path, source, text) -> a checked claim a row, see CHECKED."""
    asked = materialize(claims_of(targets, words, extractor), "asked-claims")
    chunks = materialize(reference_chunks(references), "reference-chunks")
    found = retrieval.search(asked, chunks, verify.claim_keywords(asked).select(F.col("keyword").alias("term"))) if options.retrieve else None
    checked = verify.check_claims(asked, chunks, found).select("claim_id", "status", "source", "snippet", "matched_keyword", "context_brief", "warnings", "candidates")
    rows = asked.select("claim_id", "target_path", "pos", "kind", "claim_text", "numbers", "entities", "sub_claims").join(checked, "claim_id")
    if options.conflicts:
        rows = _with_conflicts(rows)
    rows = materialize(rows.withColumns({"verifiable": F.lit(None).cast("boolean"), "citation": F.lit(None).cast("string"), "reasoning": F.lit(None).cast("string")}), "checked")
    rows = model.classify(model.judge(rows, judge), classifier)
    return rows.select(*(F.col(f.split()[0]) for f in _fields()))


def _fields() -> list[str]:
    out, depth, part = [], 0, ""
    for c in CHECKED:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def _with_conflicts(rows: DataFrame) -> DataFrame:
    found = claims.conflicts(rows.select("target_path", "claim_id", "claim_text", "entities"))
    one: Column = F.struct(F.lit("INTRA_DOC_CONFLICT").alias("code"), F.format_string("“%s”与 %d 条表述的属性不一致", "entity", "n_conflicts").alias("detail"))
    warned = found.select("claim_id", one.alias("w")).groupBy("claim_id").agg(F.array_sort(F.collect_list("w")).alias("_more"))
    return rows.join(warned, "claim_id", "left").withColumn("warnings", F.concat("warnings", F.coalesce("_more", F.array().cast("array<struct<code:string,detail:string>>")))).drop("_more")


def write_reports(rows: DataFrame, out: str, options: Options = Options(), n_references: int | None = None, workbook: str | None = None) -> str:
    """Writes the Markdown reports and, if a path is given, the workbook; the summary comes back."""
    date = options.date or datetime.date.today().isoformat()
    files.write_markdown(report.markdown_lines(rows, date=date, n_references=n_references), f"{out}/report")
    if workbook:
        write_workbook(rows, workbook)
    return report.console_summary(rows)


def check_folder(spark: SparkSession, target: str, references: str, out: str, options: Options = Options(), workbook: str | None = None, extractor: model.Client | None = None, judge: model.Client | None = None, classifier: model.Client | None = None) -> str:
    """The whole check: a target file or folder, a folder of references; JSON lines of all and of suspicious claims, files set
    aside, reports and converted texts go to `out`. The summary comes back. Word documents converted in an earlier run of the
    same `out` aren't converted again."""
    cache, done = f"{out}/converted", None
    if _exists(spark, cache):
        done = materialize(spark.read.schema("path string, text string, error string").parquet(cache), "converted-before")
    docs = materialize(files.loaded(spark, references, done, options.doc), "loaded")
    docs.filter("not endswith(path, '.txt')").write.mode("overwrite").parquet(cache)
    files.set_aside(docs).write.mode("overwrite").json(f"{out}/set_aside")
    texts = materialize(files.named_texts(docs), "references")
    rows = check(files.target_texts(spark, target, options.doc), texts, files.words_in(spark, options.words, references), options, extractor, judge, classifier)
    files.write_checks(rows, out)
    return write_reports(files.read_checks(spark, out, CHECKED), out, options, texts.count(), workbook)


def regenerate(spark: SparkSession, out: str, options: Options = Options(), workbook: str | None = None) -> str:
    """Reports anew from the claims written before, maybe changed by hand since."""
    return write_reports(files.read_checks(spark, out, CHECKED), out, options, None, workbook)


def evaluate_run(spark: SparkSession, annotations: str, out: str, run: Callable[[], object] | None = None, test_set: str | None = None, calls: DataFrame | None = None) -> dict[str, object]:
    """Recall of the claims in `out` against annotated ones, in all and by kind, with the confusion of statuses, the items
    without a match, the seconds of `run` a target, and the counts of model calls. run: what makes `out`, if not there yet."""
    began = time.perf_counter()
    if run is not None:
        run()
    seconds = time.perf_counter() - began if run is not None else None
    rows = files.read_checks(spark, out, CHECKED)
    gold = files.read_annotations(spark, annotations).withColumn("item_id", F.xxhash64("claim_text", "test_set"))
    gold = materialize(gold if test_set is None else gold.filter(F.col("test_set") == test_set), "gold")
    results = rows.select("claim_id", "claim_text", "status", "source", "snippet")
    scored = materialize(evaluate.score_gold(gold, results), "scored")
    targets = rows.select("target_path").distinct().count()
    return {
        "recall": evaluate.recall(scored), "by_type": evaluate.recall(scored, "miss_type"), "confusion": evaluate.confusion(scored), "details": scored,
        "unmatched": gold.join(evaluate.match_gold(gold.select("item_id", "claim_text"), results.select("claim_id", "claim_text")).select("item_id"), "item_id", "left_anti").select("item_id", "claim_text"),
        "seconds": seconds, "seconds_a_target": seconds / max(1, targets) if seconds is not None else None, "calls": model.call_counts(calls) if calls is not None else None,
    }


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
