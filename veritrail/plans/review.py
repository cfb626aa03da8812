"""Queries on checked claims: adjudication, reports, evaluation, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import adjudicate, claims, evaluate, model, report
from ..sources import checks, documents, gold, verdicts
from ..sources.files import annotation_rows
from . import sql as S


def context_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.neighbours(checks(spark, sf_dir, "claim_id", "target_path", "pos", "claim_text"))
    return rows.select("claim_id", "before", "after")


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = adjudicate.judge_queue(checks(spark, sf_dir))
    return claims.batches(queue, "claim_id", L.JUDGE_BATCH, "target_path").select("claim_id", "target_path", "batch_no", F.col("index").cast("int").alias("index"))


def classify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir, "claim_id", "target_path", "status").join(verdicts(spark, sf_dir).select("claim_id", "verifiable"), "claim_id", "left")
    return claims.batches(adjudicate.classify_queue(rows), "claim_id", L.CLASSIFY_BATCH, "target_path").select("claim_id", "batch_no", F.col("index").cast("int").alias("index"))


def batch_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.batch_messages(adjudicate.judge_queue(checks(spark, sf_dir)))
    return rows.select("target_path", "batch_no", "n", F.length("message").alias("n_chars"), F.md5("message").alias("digest"))


def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of the message, with and without fields."""
    queue = adjudicate.classify_queue(checks(spark, sf_dir).withColumn("verifiable", F.lit(None).cast("boolean")))
    both = [model.classify_messages(queue, fields).select(F.lit(form).alias("form"), "target_path", "batch_no", F.md5("message").alias("digest")) for form, fields in (("text", False), ("fields", True))]
    return both[0].unionByName(both[1])


def prefilter_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.prefilter_messages(checks(spark, sf_dir, "claim_id", "target_path", "pos", "claim_text")).select("target_path", "batch_no", "n", F.md5("message").alias("digest"))


def adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.judge_queue(checks(spark, sf_dir)).select("claim_id", "status", F.size("evidence").alias("n_evidence"))


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudicate.apply_verdicts(checks(spark, sf_dir), verdicts(spark, sf_dir))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(spark, sf_dir).groupBy(F.when(F.col("verifiable").isNull(), "unlabelled").when(F.col("verifiable"), "yes").otherwise("no").alias("verifiable"))
    return rows.agg(F.count(F.lit(1)).alias("n_claims"))


def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts written as a model's answers, some in code fences or amid words, and read again."""
    answer = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("index"), "verdict", "citation", "reasoning", F.when(F.col("verifiable"), "yes").otherwise("no").alias("verifiable"))).alias("results")))
    wrapped = F.when(F.col("claim_id") % 3 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(F.col("claim_id") % 3 == 1, F.concat(F.lit("好的："), answer, F.lit("。"))).otherwise(answer)
    rows = verdicts(spark, sf_dir).select("claim_id", F.explode(adjudicate.repaired(wrapped)).alias("r"))
    return rows.select("claim_id", "r.index", "r.verdict", "r.citation", "r.reasoning", "r.verifiable")


def prefilter_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = verdicts(spark, sf_dir).select("claim_id", F.coalesce("verifiable", F.lit(True)).alias("needs_check"))
    return adjudicate.prefilter(checks(spark, sf_dir, "claim_id", "target_path"), answers).groupBy("target_path").agg(F.count(F.lit(1)).alias("n_kept"))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(checks(spark, sf_dir), "target_path")


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sectioned(checks(spark, sf_dir)).select("target_path", "section_no", "section", "item_no", "claim_id")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir).join(verdicts(spark, sf_dir).select("claim_id", "verifiable"), "claim_id", "left")
    return report.markdown_lines(rows, date="2026-01-01", n_references=9)


def report_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the five sheets, with a digest of what else is in them."""
    out = None
    for name, df in report.sheets(checks(spark, sf_dir)).items():
        cells = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != "claim_id"))
        part = df.select(F.lit(name).alias("sheet"), "claim_id", F.md5(cells).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def advice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sheets(checks(spark, sf_dir))["warned"].select("claim_id", "codes", "advice")


def coverage_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sheets(checks(spark, sf_dir))["coverage"].select("claim_id", "names", "note")


def eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_gold(gold(spark, sf_dir).select("item_id", "claim_text"), checks(spark, sf_dir, "claim_id", "claim_text"))


def eval_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against whole documents, some of which hold annotated items."""
    docs = documents(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim_text"))
    return evaluate.match_gold(gold(spark, sf_dir).select("item_id", "claim_text"), docs)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_gold(gold(spark, sf_dir), checks(spark, sf_dir, "claim_id", "claim_text", "status", "source", "snippet"))


def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_scored(spark, sf_dir), "test_set")


def eval_recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_scored(spark, sf_dir), "miss_type")


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_scored(spark, sf_dir))


def intra_doc_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.conflicts(checks(spark, sf_dir, "claim_id", "target_path", "claim_text", "entities"))


def ab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a claim holds by the rules, beside what the model said of it."""
    rules = checks(spark, sf_dir, "claim_id", "status").select("claim_id", F.when(F.contains(F.coalesce("status", F.lit("")), F.lit("✓")), "yes").otherwise("no").alias("answer"))
    model = verdicts(spark, sf_dir).select("claim_id", F.when(F.col("verdict") == "support", "yes").otherwise("no").alias("answer"))
    return evaluate.compare_runs(rules, model, "claim_id", "answer")


def survival_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated items that no claim with a verifiable verdict holds or is held by."""
    kept = checks(spark, sf_dir, "claim_id", "claim_text").join(verdicts(spark, sf_dir).filter("verifiable").select("claim_id"), "claim_id", "left_semi")
    return evaluate.lost_items(gold(spark, sf_dir).select("item_id", "claim_text"), kept.select(F.col("claim_id").alias("text_id"), F.col("claim_text").alias("text"))).select("item_id")


def jsonl_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated items written as JSON lines, amid comments, blank lines and damaged lines, and read again."""
    source = F.when(F.col("expected_source").isNotNull(), F.struct(F.col("expected_source.source_path").alias("sourcePath"), F.col("expected_source.snippet").alias("片段")))
    line = F.to_json(F.struct(F.col("claim_text").alias("声明文本"), F.col("expected_status").alias("期望状态"), source.alias("期望出处"), F.col("miss_type").alias("漏检类型"), F.col("note").alias("备注"), F.col("test_set").alias("测试集")))
    lines = gold(spark, sf_dir).select(F.explode(F.array(line, F.lit("# comment"), F.lit(""), F.lit('{"声明文本": '), F.lit('{"声明文本": "x"}'))).alias("value"))
    return annotation_rows(lines).select("claim_text", "expected_status", F.col("expected_source.source_path").alias("source_path"), "miss_type", "test_set")


QUERIES = (
    context_lag_lead, batch_assign, classify_batches, batch_messages, classify_messages, prefilter_messages, adjudication_queue, verdict_merge, verdict_counts, llm_parse, prefilter_kept, status_summary, section_numbers, report_rows,
    report_sheets, advice_text, coverage_notes, eval_match, eval_match_documents, eval_recall, eval_recall_by_type, eval_confusion, intra_doc_conflicts, ab_diff, survival_check, jsonl_annotations,
)

_VERDICTS = "answers AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY answered_ts DESC, verdict DESC NULLS LAST) AS rn FROM llm_verdicts) WHERE rn = 1)"
_EVIDENCE = "ev AS (SELECT *, CASE WHEN trim(coalesce(snippet, '')) <> '' THEN 1 ELSE 0 END AS n_evidence, len(coalesce(warnings, [])) > 0 AS warned FROM claims)"
_QUEUE = f"{S.CLAIMS}, {_EVIDENCE}, queue AS (SELECT * FROM ev WHERE contains(status, '✗') OR (contains(status, '需核实') AND n_evidence > 0) OR (contains(status, '✓') AND warned AND n_evidence > 0))"
_MEANT = "CASE " + " ".join(f"WHEN v = '{k}' THEN '{s}'" for k, s in adjudicate.VERDICTS.items()) + " END"
_CODES = "list_transform(coalesce(warnings, []), lambda w: w.code)"
_FLAGS = "fl AS (SELECT *, coalesce(contains(status, '✗'), false) AS nf, coalesce(contains(status, '△'), false) AS tri, coalesce(contains(status, '✓'), false) AS conf, len(coalesce(warnings, [])) > 0 AS warned FROM claims)"
_SECTIONS = "se AS (SELECT *, 1 AS section_no, 'not_found' AS section FROM fl WHERE nf UNION ALL SELECT *, 2, 'flagged' FROM fl WHERE warned OR tri UNION ALL SELECT *, 3, 'confirmed' FROM fl WHERE conf), sn AS (SELECT *, row_number() OVER (PARTITION BY target_path, section_no ORDER BY pos, claim_id) AS item_no FROM se)"
_COUNTS = "count(*) AS n_claims, count(*) FILTER (WHERE conf) AS n_confirmed, count(*) FILTER (WHERE nf) AS n_not_found, count(*) FILTER (WHERE tri) AS n_attention, count(*) FILTER (WHERE warned) AS n_warned, count(*) FILTER (WHERE len(coalesce(sub_claims, [])) > 1) AS n_compound, count(*) FILTER (WHERE len(coalesce(entities, [])) > 0) AS n_with_entities"


def _advice(list_sql: str) -> str:
    parts = ", ".join(f"CASE WHEN list_has_any({list_sql}, {list(names)}) THEN '{text}' END" for names, text in report.ADVICE)
    return f"coalesce(nullif(concat_ws('; ', {parts}), ''), '{report.NO_ADVICE}')"


def _bracket(label: str, items: str, mark: str) -> str:
    return f"CASE WHEN len(coalesce({items}, [])) > 0 THEN '（{label}：' || array_to_string({items}, '{mark}') || '）' ELSE '' END"


def _cell(label: str, value: str) -> str:
    return f"'| {label} | ' || {value} || ' |'"


def _dash(value: str) -> str:
    return f"coalesce(nullif({value}, ''), '—')"


_NOTE = f"CASE WHEN len({_CODES}) = 0 THEN '✓ 实体全部匹配' WHEN list_has_any({_CODES}, ['ENTITY_UNCOVERED', 'entity_uncovered']) THEN array_to_string({_CODES}, '; ') ELSE '见反向验证警告' END"
_HEAD80 = "replace(left(claim_text, 80), '|', '｜')"
_CUT = "CASE WHEN length(snippet) > 120 THEN left(snippet, 120) || '…' ELSE snippet END"
_DETAILS = "array_to_string(list_transform(coalesce(warnings, []), lambda w: concat_ws('：', w.code, nullif(w.detail, ''))), '; ')"
_REPORT = f"""it AS (SELECT sn.*, v.verifiable FROM sn LEFT JOIN v ON v.claim_id = sn.claim_id),
  bo AS (SELECT target_path, section_no, item_no, CASE section WHEN 'not_found' THEN ['| ' || item_no || ' | ' || CASE WHEN verifiable THEN '🔍 可核实' WHEN NOT verifiable THEN '— 不可核实' ELSE '' END || ' | ' || {_HEAD80} || ' | ' || {_dash("array_to_string(entities, '、')")} || ' | ' || {_dash("array_to_string(numbers, '、')")} || ' |']
    WHEN 'flagged' THEN ['', '### ' || item_no || ' · ' || coalesce(status, ''), '', '**表述：**  ', claim_text, '', '| 字段 | 内容 |', '|------|------|', {_cell('出处', _dash('source'))}, {_cell('原文片段', f"coalesce('`' || replace(nullif({_CUT}, ''), '`', '') || '`', '—')")},
      {_cell('匹配关键词', _dash('matched_keyword'))}, {_cell('警告', _dash(_DETAILS))}, {_cell('建议', _advice(_CODES))}]
    ELSE ['| ' || item_no || ' | ' || {_HEAD80} || ' | ' || {_dash('source')} || CASE WHEN warned THEN ' ⚠' ELSE '' END || ' |'] END AS ls FROM it),
  ct AS (SELECT target_path, {_COUNTS}, count(*) FILTER (WHERE warned OR tri) AS n_flagged, count(*) FILTER (WHERE nf AND verifiable) AS yes, count(*) FILTER (WHERE nf AND NOT verifiable) AS no, count(*) FILTER (WHERE nf AND verifiable IS NULL) AS un FROM fl LEFT JOIN v ON v.claim_id = fl.claim_id GROUP BY target_path),
  he AS (SELECT target_path, 0 AS section_no, ['# 核对清单 — ' || target_path, '生成时间：2026-01-01  参考文档：9 份  共 ' || n_claims || ' 条', '', '## 概览', '✗ 未找到：' || n_not_found || '　　⚠ 反向验证重点关注：' || n_warned || '　　△ 需关注：' || n_attention || '　　✓ 已确认：' || n_confirmed, '', '---'] AS ls FROM ct
    UNION ALL SELECT target_path, 1, list_filter(['', '## ✗ 未找到（' || n_not_found || ' 条），建议人工逐条核查', CASE WHEN yes + no > 0 THEN '> 可核实（建议优先核查）：' || yes || ' 条　　不可核实（修辞、标题、原则）：' || no || ' 条　　未标注：' || un || ' 条' END,
      CASE WHEN n_not_found = 0 THEN '（无）' END, CASE WHEN n_not_found > 0 THEN '' END, CASE WHEN n_not_found > 0 THEN '| # | 可核实性 | 表述内容 | 命中实体 | 命中数字 |' END, CASE WHEN n_not_found > 0 THEN '|---|---------|---------|---------|--------|' END], lambda x: x IS NOT NULL) FROM ct
    UNION ALL SELECT target_path, 2, list_filter(['', '---', '', '## ⚠ 反向验证重点关注（' || n_flagged || ' 条）', CASE WHEN n_flagged = 0 THEN '（无）' END], lambda x: x IS NOT NULL) FROM ct
    UNION ALL SELECT target_path, 3, list_filter(['', '---', '', '## ✓ 已确认（' || n_confirmed || ' 条）', CASE WHEN n_confirmed = 0 THEN '（无）' END] || CASE WHEN n_confirmed > 0 THEN ['<details><summary>展开查看</summary>', '', '| # | 表述内容（前 80 字） | 出处 |', '|---|------------------|------|'] ELSE [] END, lambda x: x IS NOT NULL) FROM ct
    UNION ALL SELECT target_path, 4, ['', '</details>'] FROM ct WHERE n_confirmed > 0),
  al AS (SELECT target_path, section_no, item_no, ls FROM bo UNION ALL SELECT target_path, section_no, 0, ls FROM he), report AS (SELECT target_path, section_no, item_no, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM al)"""
_GOLD = f"""{S.CLAIMS}, eq AS (SELECT item_id, min(c.claim_id) AS claim_id, min(length(g.claim_text)) AS overlap FROM gold_annotations g JOIN claims c ON g.claim_text = c.claim_text GROUP BY item_id),
  rest AS (SELECT item_id, replace(claim_text, ' ', '') AS item FROM gold_annotations WHERE item_id NOT IN (SELECT item_id FROM eq)), tx AS (SELECT claim_id, replace(claim_text, ' ', '') AS t FROM claims),
  mt AS (SELECT item_id, claim_id, list_max(list_filter(range({evaluate.LEAST_OVERLAP}, least(length(item), length(t)) + 1), lambda n: contains(t, substr(item, 1, n)))) AS overlap FROM rest JOIN tx ON length(item) >= {evaluate.LEAST_OVERLAP} AND contains(t, substr(item, 1, {evaluate.LEAST_OVERLAP}))),
  be AS (SELECT item_id, claim_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, claim_id) AS rn FROM mt) WHERE rn = 1),
  gm AS (SELECT item_id, claim_id, CAST(overlap AS INTEGER) AS overlap FROM eq UNION ALL SELECT item_id, claim_id, CAST(overlap AS INTEGER) FROM be)"""
_GOLD_DOCUMENTS = _GOLD.replace(S.CLAIMS, "claims AS (SELECT doc_id AS claim_id, text AS claim_text FROM documents)")
_SCORED = f"""{_GOLD}, s0 AS (SELECT g.*, gm.claim_id, c.status AS fs, c.source AS fo, c.snippet AS fp, {S.statuses('g.expected_status')} AS expected, CASE WHEN gm.claim_id IS NULL THEN 'not_found' ELSE {S.statuses("coalesce(c.status, '')")} END AS predicted,
    left(regexp_replace(regexp_extract(g.expected_source.source_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), 20) AS stem, left(g.expected_source.snippet, 20) AS head FROM gold_annotations g LEFT JOIN gm ON gm.item_id = g.item_id LEFT JOIN claims c ON c.claim_id = gm.claim_id),
  scored AS (SELECT *, expected = predicted AS h1, expected = predicted OR coalesce(stem <> '' AND contains(fo, stem), false) OR coalesce(head <> '' AND contains(fp, head), false) AS h5 FROM s0)"""
_RECALL = "count(*) AS n_items, avg(CAST(h1 AS DOUBLE)) AS recall_1, avg(CAST(h5 AS DOUBLE)) AS recall_5"
_WORDS = f"[w for w in regexp_extract_all(substr(claim_text, greatest(pl - {L.ATTRIBUTE_WINDOW}, 1), pl + length(entity) + {L.ATTRIBUTE_WINDOW} - greatest(pl - {L.ATTRIBUTE_WINDOW}, 1)), '[一-鿿]{{3,15}}') if NOT contains(entity, w)]"

SQL = {
    "context_lag_lead": f"WITH {S.CLAIMS} SELECT claim_id, coalesce(lag(claim_text) OVER w, '') AS before, coalesce(lead(claim_text) OVER w, '') AS after FROM claims WINDOW w AS (PARTITION BY target_path ORDER BY pos, claim_id)",
    "batch_assign": f"WITH {_QUEUE}, n AS (SELECT claim_id, target_path, row_number() OVER (PARTITION BY target_path ORDER BY claim_id) - 1 AS n FROM queue) SELECT claim_id, target_path, n // {L.JUDGE_BATCH} AS batch_no, CAST(n % {L.JUDGE_BATCH} + 1 AS INTEGER) AS index FROM n",
    "classify_batches": f"WITH {S.CLAIMS}, {_VERDICTS}, n AS (SELECT c.claim_id, row_number() OVER (PARTITION BY target_path ORDER BY c.claim_id) - 1 AS n FROM claims c LEFT JOIN answers a USING (claim_id) WHERE contains(status, '✗') AND a.verifiable IS NULL) SELECT claim_id, n // {L.CLASSIFY_BATCH} AS batch_no, CAST(n % {L.CLASSIFY_BATCH} + 1 AS INTEGER) AS index FROM n",
    "adjudication_queue": f"WITH {_QUEUE} SELECT claim_id, status, CAST(n_evidence AS INTEGER) AS n_evidence FROM queue",
    "verdict_merge": f"""WITH {_QUEUE}, {_VERDICTS}, j AS (SELECT q.claim_id, q.status, q.n_evidence, a.claim_id IS NOT NULL AS answered, lower(trim(a.verdict)) AS v, trim(a.citation) AS ci, trim(a.reasoning) AS re, a.verifiable FROM queue q LEFT JOIN answers a ON a.claim_id = q.claim_id),
      k AS (SELECT *, {_MEANT} AS meant FROM j)
      SELECT claim_id, CASE WHEN meant IS NOT NULL AND n_evidence > 0 THEN meant ELSE status END AS status, CASE WHEN meant IS NOT NULL AND ci <> '' THEN ci END AS citation, CASE WHEN meant IS NOT NULL AND re <> '' THEN re END AS reasoning, CASE WHEN meant IS NOT NULL THEN verifiable END AS verifiable,
        CASE WHEN NOT answered THEN 'NO_ANSWER' WHEN meant IS NULL THEN 'UNKNOWN_VERDICT:' || coalesce(v, '') WHEN meant IN ('{L.REVIEW}', '{L.INCONSISTENT}') AND coalesce(re, '') <> '' THEN 'LLM_NOTE:' || re END AS note FROM k""",
    "verdict_counts": f"WITH {_VERDICTS} SELECT CASE WHEN verifiable IS NULL THEN 'unlabelled' WHEN verifiable THEN 'yes' ELSE 'no' END AS verifiable, count(*) AS n_claims FROM answers GROUP BY 1",
    "llm_parse": f"WITH {_VERDICTS} SELECT claim_id, CAST(1 AS INTEGER) AS index, verdict, citation, reasoning, CASE WHEN verifiable THEN 'yes' ELSE 'no' END AS verifiable FROM answers",
    "prefilter_kept": f"WITH {S.CLAIMS}, {_VERDICTS} SELECT target_path, count(*) AS n_kept FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM answers WHERE NOT coalesce(verifiable, true)) GROUP BY 1",
    "status_summary": f"WITH {S.CLAIMS}, {_FLAGS} SELECT target_path, {_COUNTS} FROM fl GROUP BY 1",
    "section_numbers": f"WITH {S.CLAIMS}, {_FLAGS}, {_SECTIONS} SELECT target_path, CAST(section_no AS INTEGER) AS section_no, section, CAST(item_no AS INTEGER) AS item_no, claim_id FROM sn",
    "report_sheets": f"""WITH {S.CLAIMS}, {_FLAGS}, t AS (SELECT *, coalesce(array_to_string({_CODES}, '; '), '') AS cs, coalesce(array_to_string(numbers, ', '), '') AS ns, coalesce(array_to_string(entities, ', '), '') AS es, target_path || chr(31) || coalesce(kind, '') || chr(31) || claim_text || chr(31) || coalesce(status, '') AS base FROM fl)
      SELECT 'all' AS sheet, claim_id, md5(base || chr(31) || coalesce(source, '') || chr(31) || coalesce(snippet, '') || chr(31) || cs || chr(31) || ns) AS digest FROM t
      UNION ALL SELECT 'confirmed', claim_id, md5(base || chr(31) || coalesce(source, '') || chr(31) || coalesce(snippet, '') || chr(31) || cs) FROM t WHERE conf UNION ALL SELECT 'pending', claim_id, md5(base || chr(31) || coalesce(snippet, '')) FROM t WHERE nf OR tri
      UNION ALL SELECT 'warned', claim_id, md5(base || chr(31) || ns || chr(31) || coalesce(matched_keyword, '') || chr(31) || cs || chr(31) || {_advice(_CODES)}) FROM t WHERE warned
      UNION ALL SELECT 'coverage', claim_id, md5(target_path || chr(31) || left(claim_text, 80) || chr(31) || es || chr(31) || coalesce(status, '') || chr(31) || {_NOTE}) FROM t WHERE len(coalesce(entities, [])) > 0""",
    "report_rows": f"""WITH {S.CLAIMS}, {_FLAGS}, {_VERDICTS}, {_SECTIONS}, v AS (SELECT claim_id, any_value(verifiable) AS verifiable FROM answers GROUP BY claim_id), {_REPORT} SELECT target_path, CAST(section_no AS INTEGER) AS section_no, CAST(item_no AS INTEGER) AS item_no, CAST(line_no AS INTEGER) AS line_no, line FROM report""",
    "batch_messages": f"""WITH {_QUEUE}, n AS (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY claim_id) - 1 AS n0 FROM queue),
      m AS (SELECT target_path, n0 // {L.JUDGE_BATCH} AS batch_no, n0, '【声明 ' || (n0 % {L.JUDGE_BATCH} + 1) || '】' || claim_text || {_bracket('数字', 'numbers', ', ')} || {_bracket('专名', 'entities', ', ')}
        || CASE WHEN len(coalesce(sub_claims, [])) > 1 THEN '（子命题：' || array_to_string(list_transform(sub_claims, lambda s: s.text), '；') || '）' ELSE '' END || chr(10)
        || CASE WHEN n_evidence > 0 THEN '【证据】' || chr(10) || '  [1]' || coalesce(source, '') || ': ' || left(snippet, 500) ELSE '【证据】（无候选证据）' END || chr(10) AS part FROM n),
      g AS (SELECT target_path, batch_no, count(*) AS n, string_agg(part, chr(10) ORDER BY n0) AS message FROM m GROUP BY ALL) SELECT target_path, batch_no, n, CAST(length(message) AS INTEGER) AS n_chars, md5(message) AS digest FROM g""",
    "classify_messages": f"""WITH {S.CLAIMS}, n AS (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY claim_id) - 1 AS n0 FROM claims WHERE contains(status, '✗')),
      m AS (SELECT target_path, n0 // {L.CLASSIFY_BATCH} AS batch_no, n0, '【' || (n0 % {L.CLASSIFY_BATCH} + 1) || '】' || claim_text AS part, concat_ws(' / ', CASE WHEN len(coalesce(numbers, [])) > 0 THEN '数字：' || array_to_string(numbers, ', ') END, CASE WHEN len(coalesce(entities, [])) > 0 THEN '实体：' || array_to_string(entities[1:5], ', ') END) AS f FROM n)
      SELECT 'text' AS form, target_path, batch_no, md5(string_agg(part, chr(10) ORDER BY n0)) AS digest FROM m GROUP BY target_path, batch_no
      UNION ALL SELECT 'fields', target_path, batch_no, md5(string_agg(part || CASE WHEN f <> '' THEN chr(10) || '  （' || f || '）' ELSE '' END, chr(10) ORDER BY n0)) FROM m GROUP BY target_path, batch_no""",
    "prefilter_messages": f"""WITH {S.CLAIMS}, c AS (SELECT *, lag(claim_text) OVER w AS b, lead(claim_text) OVER w AS a FROM claims WINDOW w AS (PARTITION BY target_path ORDER BY pos, claim_id)), n AS (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY claim_id) - 1 AS n0 FROM c)
      SELECT target_path, n0 // {L.CLASSIFY_BATCH} AS batch_no, count(*) AS n, md5(string_agg('【' || (n0 % {L.CLASSIFY_BATCH} + 1) || '】' || claim_text || CASE WHEN b <> '' THEN chr(10) || '  前句：' || left(b, 60) ELSE '' END || CASE WHEN a <> '' THEN chr(10) || '  后句：' || left(a, 60) ELSE '' END || chr(10), chr(10) ORDER BY n0)) AS digest FROM n GROUP BY ALL""",
    "advice_text": f"WITH {S.CLAIMS}, {_FLAGS} SELECT claim_id, array_to_string({_CODES}, '; ') AS codes, {_advice(_CODES)} AS advice FROM fl WHERE warned",
    "coverage_notes": f"WITH {S.CLAIMS} SELECT claim_id, array_to_string(entities, ', ') AS names, CASE WHEN len({_CODES}) = 0 THEN '✓ 实体全部匹配' WHEN list_has_any({_CODES}, ['ENTITY_UNCOVERED', 'entity_uncovered']) THEN array_to_string({_CODES}, '; ') ELSE '见反向验证警告' END AS note FROM claims WHERE len(coalesce(entities, [])) > 0",
    "eval_match": f"WITH {_GOLD} SELECT * FROM gm",
    "eval_match_documents": f"WITH {_GOLD_DOCUMENTS} SELECT * FROM gm",
    "eval_recall": f"WITH {_SCORED} SELECT test_set, {_RECALL} FROM scored GROUP BY 1",
    "eval_recall_by_type": f"WITH {_SCORED} SELECT miss_type, {_RECALL} FROM scored GROUP BY 1",
    "eval_confusion": f"WITH {_SCORED} SELECT expected, predicted, count(*) AS n_items FROM scored GROUP BY ALL",
    "intra_doc_conflicts": f"""WITH {S.CLAIMS}, e AS (SELECT DISTINCT target_path, claim_id, claim_text, unnest(entities) AS entity FROM claims), n AS (SELECT *, instr(claim_text, entity) AS pl FROM e),
      a AS (SELECT target_path, claim_id, entity, CASE WHEN pl > 0 THEN list_sort(list_distinct({_WORDS})) ELSE [] END AS ws FROM n), k AS (SELECT target_path, entity, ws, min(claim_id) AS claim_id, count(*) AS n FROM a GROUP BY ALL),
      p AS (SELECT x.target_path, x.entity, x.claim_id, x.n, y.n AS m, len(list_intersect(x.ws, y.ws)) AS i, len(list_distinct(list_concat(x.ws, y.ws))) AS u FROM k x JOIN k y ON x.target_path = y.target_path AND x.entity = y.entity AND x.claim_id <> y.claim_id)
      SELECT target_path, entity, claim_id, n, CAST(sum(m) AS BIGINT) AS n_conflicts FROM p WHERE u > 0 AND i / u < {L.ATTRIBUTE_SIMILARITY} GROUP BY ALL""",
    "ab_diff": f"""WITH {S.CLAIMS}, {_VERDICTS}, r AS (SELECT claim_id, CASE WHEN coalesce(contains(status, '✓'), false) THEN 'yes' ELSE 'no' END AS a FROM claims), m AS (SELECT claim_id, CASE WHEN verdict = 'support' THEN 'yes' ELSE 'no' END AS b FROM answers)
      SELECT coalesce(a, '?') AS value_a, coalesce(b, '?') AS value_b, count(*) AS n FROM r FULL JOIN m USING (claim_id) GROUP BY 1, 2""",
    "survival_check": f"WITH {S.CLAIMS}, {_VERDICTS}, kept AS (SELECT claim_text AS t FROM claims WHERE claim_id IN (SELECT claim_id FROM answers WHERE verifiable)) SELECT item_id FROM gold_annotations g WHERE NOT EXISTS (SELECT 1 FROM kept WHERE contains(t, claim_text) OR contains(claim_text, t))",
    "jsonl_annotations": "SELECT claim_text, expected_status, expected_source.source_path AS source_path, miss_type, test_set FROM gold_annotations",
}
