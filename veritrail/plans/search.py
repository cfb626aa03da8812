"""Queries that look claims up in reference texts.

The checks take every claim. Only the retrieval queries (claim_status_retrieved, bm25_phrase_rank, like_rank,
rrf_fusion, anchor_penalty) are searches, with the claims whose id is divisible by 100 for their query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import claims as C
from ..operators import retrieval, verify
from ..session import materialize
from ..sources import checks, chunks, words
from . import sql as S


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, claim_text, numbers, entities as stored, and sub_claims taken from the text."""
    pattern = T.category_pattern(C.category_words(words(spark, sf_dir)))
    rows = checks(spark, sf_dir, "claim_id", "claim_text", "numbers", "entities")
    return rows.select("claim_id", "claim_text", "numbers", "entities", T.clauses(F.col("claim_text"), pattern).alias("sub_claims"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the retrieval queries."""
    return every(spark, sf_dir).filter("claim_id % 100 = 0")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "chunk_id", "source_path", "source", "chunk_offset", "text")


def _placed(terms: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole texts, the places of the terms in them, and the first place by text."""
    whole = verify.whole_texts(texts, terms)
    hits = materialize(verify.document_hits(terms, whole), "hits")
    return whole, hits, materialize(verify.term_places(hits), "places")


def _facts(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    return verify.term_facts(_placed(terms, corpus(spark, sf_dir))[2])


def _keywords(claims: DataFrame) -> DataFrame:
    return verify.claim_keywords(claims).select(F.col("keyword").alias("term"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, texts = every(spark, sf_dir), corpus(spark, sf_dir)
    whole, _, placed = _placed(_keywords(claims), texts)
    return verify.matches(claims, placed, verify.term_facts(placed), texts, whole)


def match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).drop("snippet")


def snippet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("claim_id", "keyword", "snippet")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = every(spark, sf_dir)
    terms = verify.clause_keywords(verify.claim_clauses(claims)).select("term")
    return verify.clause_support(claims, _facts(spark, sf_dir, terms)).select("claim_id", "clause_no", "clause", "anchored", "supported")


def subclaim_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).filter("supported").drop("supported")


def subclaim_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).filter("not supported").drop("supported")


def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = every(spark, sf_dir)
    covered = verify.entity_coverage(claims, _facts(spark, sf_dir, verify.claim_entities(claims).select(F.col("entity").alias("term"))))
    return covered.withColumn("coverage", F.round("coverage", 6))


def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = every(spark, sf_dir)
    present = verify.number_presence(claims, _facts(spark, sf_dir, verify.claim_numbers(claims).select(F.col("number").alias("term"))))
    return present.filter("not present").select("claim_id", "number").distinct()


def cooccurrence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, texts = every(spark, sf_dir), corpus(spark, sf_dir)
    whole, hits, placed = _placed(_keywords(claims).unionByName(verify.claim_entities(claims).select(F.col("entity").alias("term"))), texts)
    facts = verify.term_facts(placed)
    return verify.misattributed(claims, verify.matches(claims, placed, facts, texts, whole), hits, facts)


def growth_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, texts = every(spark, sf_dir), corpus(spark, sf_dir)
    whole, _, placed = _placed(verify.claim_numbers(claims).select(F.col("number").alias("term")).filter("endswith(term, '%')"), texts)
    return verify.growth_context(claims, placed, whole)


def keyword_generality(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, texts = every(spark, sf_dir), corpus(spark, sf_dir)
    whole, _, placed = _placed(_keywords(claims), texts)
    facts = verify.term_facts(placed)
    return verify.keyword_generality(verify.matches(claims, placed, facts, texts, whole), facts, texts)


_STATUS = ("claim_id", "status", "source", "matched_keyword", "n_clauses", "n_supported", "n_entities", "n_misattributed", "n_numbers", "n_missing", "n_growth_misses", "short", "generic", "quoted_found")


def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, warnings and facts of each claim, the match found by plain search."""
    checked = verify.check_claims(every(spark, sf_dir), corpus(spark, sf_dir))
    return checked.select(*_STATUS, F.concat_ws("; ", "codes").alias("codes"))


def claim_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each warning of each claim with what it is about."""
    checked = verify.check_claims(every(spark, sf_dir), corpus(spark, sf_dir))
    return checked.select("claim_id", F.explode("warnings").alias("w")).select("claim_id", "w.code", "w.detail")


def claim_status_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the match taken from the retrieved candidates where one has a keyword."""
    claims, texts = asked(spark, sf_dir), corpus(spark, sf_dir)
    checked = verify.check_claims(claims, texts, retrieval.search(claims, texts, _keywords(claims)))
    return checked.select(*_STATUS, F.concat_ws("; ", "codes").alias("codes"))


def status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of facts that the rules tell apart, with its status."""
    cases = {
        "found": (True, False), "n_clauses": (0, 1, 2), "n_supported": (0, 2), "n_entities": (0, 1, 2), "coverage": (0.0, 50.0, 100.0), "n_misattributed": (0, 1),
        "n_numbers": (0, 2), "n_missing": (0, 1, 2), "n_growth_misses": (0, 1), "short": (True, False), "generic": (True, False), "quoted_found": (True, False),
    }
    rows = spark.range(1).select()
    for name, values in cases.items():
        kind = {bool: "boolean", float: "double", int: "bigint"}[type(values[0])]
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(name))
    return verify.cascade(rows).withColumn("codes", F.concat_ws("; ", "codes"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_terms(asked(spark, sf_dir))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_terms(every(spark, sf_dir))


def bm25_phrase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    long = _terms(spark, sf_dir).filter("length(replace(term, ' ', '')) >= 3").select("term")
    return retrieval.bm25(retrieval.phrase_hits(long, texts), texts).withColumn("score", F.round("score", 6))


def like_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir)
    short = _terms(spark, sf_dir).filter("length(replace(term, ' ', '')) < 3").select("term")
    return retrieval.counted(retrieval.phrase_hits(short, texts))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.candidates(asked(spark, sf_dir), corpus(spark, sf_dir))


def anchor_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, texts = asked(spark, sf_dir), corpus(spark, sf_dir)
    return retrieval.scores(claims, texts).groupBy("claim_id", "penalised").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.max("score"), 6).alias("best"))


QUERIES = (
    match_first, snippet_context, subclaim_semi, subclaim_anti, entity_coverage, missing_numbers, cooccurrence_range, growth_context, keyword_generality,
    claim_status, claim_warnings, claim_status_retrieved, status_cascade, search_terms, bm25_phrase_rank, like_rank, rrf_fusion, anchor_penalty,
)

_KW = f"src AS (SELECT claim_id AS id, claim_text AS txt FROM asked), {S.keywords('src')}"
_BASE = f"{S.EVERY}, {S.DOCS}, {_KW}"
_PLAIN = f"""{S.standing('kd', 'SELECT k AS term FROM kw')}, kf AS (SELECT term, min(source_path) AS source_path FROM kd GROUP BY term),
  m0 AS (SELECT id AS claim_id, min((pos, kf.source_path, k)) AS b FROM kw JOIN kf ON kf.term = k GROUP BY id)"""
_MATCH = f"""{_BASE}, {_PLAIN}, m AS (SELECT claim_id, b[3] AS keyword, docs.source_path, docs.source, docs.text FROM m0 JOIN docs ON docs.source_path = b[2])"""
_CLAUSE = f"""cl AS (SELECT id, no, part, anchored FROM clause WHERE independent), cs AS (SELECT id * 1000 + no AS id, part AS txt FROM cl WHERE anchored), {S.keywords('cs', 'ck')}, {S.standing('cd', 'SELECT k AS term FROM ck')},
  hit AS (SELECT DISTINCT id FROM ck WHERE k IN (SELECT term FROM cd)),
  support AS (SELECT cl.id AS claim_id, CAST(no AS INTEGER) AS clause_no, part AS clause, anchored, NOT anchored OR hit.id IS NOT NULL AS supported FROM cl LEFT JOIN hit ON hit.id = cl.id * 1000 + no)"""
_CLAUSES = f"{S.category_cte()}, {S.clauses('src')}, {_CLAUSE}"
_VALID = f"ve AS (SELECT claim_id, claim_text, e AS entity FROM (SELECT claim_id, claim_text, unnest(entities) AS e FROM asked) WHERE {S.valid_entity('e')}), {S.standing('ed', 'SELECT entity AS term FROM ve')}"
_COVER = f"{_VALID}, cov AS (SELECT claim_id, count(*) AS n_entities, count(*) FILTER (WHERE entity IN (SELECT term FROM ed)) AS n_covered FROM ve GROUP BY claim_id)"
_NUMS = f"nu AS (SELECT claim_id, unnest(numbers) AS number FROM asked), {S.standing('nd', 'SELECT number AS term FROM nu')}, np AS (SELECT claim_id, number, coalesce(number IN (SELECT term FROM nd), false) AS present FROM nu)"


def _places(text: str, term: str) -> str:
    """1-based places of a term, without overlaps, from the lengths of the parts between them."""
    parts = f"list_transform(string_split({text}, {term}), lambda x: length(x))"
    return f"list_transform(range(1, len({parts})), lambda i: CAST(list_sum(({parts})[1:i]) AS BIGINT) + (i - 1) * length({term}) + 1)"


_MIS = f"""named AS (SELECT DISTINCT ve.claim_id, entity, keyword FROM ve JOIN m USING (claim_id) WHERE entity <> keyword AND NOT regexp_matches(claim_text, '^[-\\s\\p{{Z}}]*政策依据[：:]')),
  known AS (SELECT n.*, f.first_source FROM named n JOIN (SELECT term, min(source_path) AS first_source FROM ed GROUP BY term) f ON f.term = entity), pairs AS (SELECT DISTINCT entity, keyword FROM known),
  ea AS (SELECT term, source_path, unnest({_places('text', 'term')}) AS x FROM ed WHERE term IN (SELECT entity FROM pairs)), ka AS (SELECT term, source_path, {_places('text', 'term')} AS b FROM kd WHERE term IN (SELECT keyword FROM pairs)),
  close_by AS (SELECT DISTINCT entity, keyword FROM pairs JOIN ea ON ea.term = entity JOIN ka ON ka.term = keyword AND ka.source_path = ea.source_path WHERE len(list_filter(b, lambda y: abs(x - y) <= {L.NEAR})) > 0),
  mis AS (SELECT claim_id, entity, first_source FROM known k WHERE NOT EXISTS (SELECT 1 FROM close_by c WHERE c.entity = k.entity AND c.keyword = k.keyword))"""
_GROWTH = f"""gw AS (SELECT DISTINCT claim_id, number, words FROM (SELECT claim_id, unnest(numbers) AS number, regexp_extract_all(claim_text, '{S.words(L.GROWTH_WORDS)}') AS words FROM asked) WHERE len(words) > 0 AND number LIKE '%\\%' ESCAPE '\\'), {S.standing('gd', 'SELECT number AS term FROM gw')},
  gx AS (SELECT term, substr(text, greatest(instr(text, term) - {L.GROWTH_RADIUS}, 1), instr(text, term) + {L.GROWTH_RADIUS} - greatest(instr(text, term) - {L.GROWTH_RADIUS}, 1)) AS around FROM gd),
  gc AS (SELECT claim_id, number, EXISTS (SELECT 1 FROM gx WHERE gx.term = number AND len(list_filter(words, lambda w: contains(around, w))) > 0) AS in_context FROM gw)"""
_GENERAL = f"""kn AS (SELECT term, CAST(sum({S.count_of('text', 'term')}) AS BIGINT) AS n_found, count(*) AS n_sources FROM kd GROUP BY term),
  kg0 AS (SELECT claim_id, keyword, coalesce(n_found, 0) AS n_found, coalesce(n_sources, 0) AS n_sources, (SELECT count(DISTINCT source_path) FROM once) AS total_sources FROM m LEFT JOIN kn ON term = keyword),
  kg AS (SELECT *, length(keyword) <= {L.SHORT_KEYWORD} AS short, n_found > {L.GENERIC_OVER} AND n_sources / total_sources < {L.DOMAIN_SHARE} AS generic FROM kg0)"""
_RULES = f"""r1 AS (SELECT *, n_clauses > 1 AND n_supported < n_clauses AS partial, (n_entities >= 2 AND coverage < {L.LOW_COVERAGE}) OR n_misattributed > 0 AS inconsistent,
    (n_numbers > 0 AND n_missing < n_numbers) OR quoted_found AS strong, short AND n_numbers > 0 AND n_missing = n_numbers AS numberless FROM facts),
  r2 AS (SELECT *, (short OR generic) AND NOT strong AND NOT partial AND NOT inconsistent AS weak FROM r1),
  r3 AS (SELECT *, (partial OR inconsistent OR weak) AND numberless AS refuted FROM r2),
  ruled AS (SELECT *, CASE WHEN NOT found OR refuted THEN '{L.NOT_FOUND}' WHEN partial THEN '{L.PARTIAL}' WHEN inconsistent THEN '{L.INCONSISTENT}' WHEN weak THEN '{L.REVIEW}' ELSE '{L.CONFIRMED}' END AS status,
    CASE WHEN NOT found THEN '' ELSE concat_ws('; ', CASE WHEN partial THEN 'SUBCLAIM_UNSOURCED' END, CASE WHEN n_entities > 0 AND coverage < 100 THEN 'ENTITY_UNCOVERED' END, CASE WHEN n_misattributed > 0 THEN 'ENTITY_MISATTRIBUTED' END,
      CASE WHEN n_missing > 0 THEN 'NUMBER_MISSING' END, CASE WHEN n_growth_misses > 0 THEN 'GROWTH_CONTEXT' END, CASE WHEN short THEN 'KEYWORD_SHORT' END, CASE WHEN generic THEN 'KEYWORD_GENERIC' END,
      CASE WHEN weak THEN 'WEAK_MATCH_DOWNGRADED' END, CASE WHEN refuted THEN 'NO_EVIDENCE' END) END AS codes FROM r3)"""
_FACTS = f"""{_CLAUSES}, {_COVER}, {_NUMS}, {_MIS}, {_GROWTH}, {_GENERAL}, qt AS (SELECT claim_id, unnest(regexp_extract_all(claim_text, '[“《"]([^”》"]{{2,40}})[”》"]', 1)) AS q FROM asked), {S.standing('qd', 'SELECT q AS term FROM qt')},
  quoted AS (SELECT DISTINCT claim_id FROM qt WHERE q IN (SELECT term FROM qd)),
  facts AS (SELECT a.claim_id, m.claim_id IS NOT NULL AS found, m.source, m.keyword AS matched_keyword,
    coalesce(s.n_clauses, 0) AS n_clauses, coalesce(s.n_supported, 0) AS n_supported, coalesce(cov.n_entities, 0) AS n_entities, coalesce(n_covered * 100 / cov.n_entities, 100) AS coverage, coalesce(mi.n, 0) AS n_misattributed,
    coalesce(pr.n_numbers, 0) AS n_numbers, coalesce(pr.n_missing, 0) AS n_missing, coalesce(g.n, 0) AS n_growth_misses, coalesce(kg.short, false) AS short, coalesce(kg.generic, false) AS generic, quoted.claim_id IS NOT NULL AS quoted_found,
    s.unsourced, cov.uncovered, mi.misplaced, pr.missing, g.growth_misses, kg.n_found, kg.n_sources, kg.total_sources
    FROM asked a LEFT JOIN m ON m.claim_id = a.claim_id LEFT JOIN kg ON kg.claim_id = a.claim_id LEFT JOIN quoted ON quoted.claim_id = a.claim_id
    LEFT JOIN (SELECT claim_id, count(*) AS n_entities, count(*) FILTER (WHERE entity IN (SELECT term FROM ed)) AS n_covered, string_agg(entity, '、' ORDER BY i) FILTER (WHERE entity NOT IN (SELECT term FROM ed)) AS uncovered
      FROM (SELECT claim_id, unnest(entities) AS entity, generate_subscripts(entities, 1) AS i FROM asked) WHERE {S.valid_entity('entity')} GROUP BY claim_id) cov ON cov.claim_id = a.claim_id
    LEFT JOIN (SELECT claim_id, count(*) AS n_clauses, count(*) FILTER (WHERE supported) AS n_supported, string_agg(clause, '；' ORDER BY clause_no) FILTER (WHERE NOT supported) AS unsourced FROM support GROUP BY claim_id) s ON s.claim_id = a.claim_id
    LEFT JOIN (SELECT claim_id, count(*) AS n, string_agg(entity || '（见于' || left(first_source, 60) || '）', '、' ORDER BY entity) AS misplaced FROM mis GROUP BY claim_id) mi ON mi.claim_id = a.claim_id
    LEFT JOIN (SELECT claim_id, count(*) AS n_numbers, count(*) FILTER (WHERE NOT present) AS n_missing, string_agg(number, '、' ORDER BY i) FILTER (WHERE NOT present) AS missing
      FROM (SELECT claim_id, number, i, coalesce(number IN (SELECT term FROM nd), false) AS present FROM (SELECT claim_id, unnest(numbers) AS number, generate_subscripts(numbers, 1) AS i FROM asked)) GROUP BY claim_id) pr ON pr.claim_id = a.claim_id
    LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE NOT in_context) AS n, string_agg(number, '、' ORDER BY number) FILTER (WHERE NOT in_context) AS growth_misses FROM gc GROUP BY claim_id) g ON g.claim_id = a.claim_id)"""
_WARNED = """SELECT claim_id, w.code, w.detail FROM (SELECT claim_id, unnest(list_filter([
    {'code': 'SUBCLAIM_UNSOURCED', 'detail': CASE WHEN partial THEN format('{} 个子命题中 {} 个有出处；无出处：{}', n_clauses, n_supported, unsourced) END},
    {'code': 'ENTITY_UNCOVERED', 'detail': CASE WHEN n_entities > 0 AND coverage < 100 THEN format('覆盖率 {:.0f}%；未找到：{}', coverage, uncovered) END},
    {'code': 'ENTITY_MISATTRIBUTED', 'detail': CASE WHEN n_misattributed > 0 THEN format('“{}”附近没有：{}', matched_keyword, misplaced) END},
    {'code': 'NUMBER_MISSING', 'detail': CASE WHEN n_missing > 0 THEN '未找到：' || missing END}, {'code': 'GROWTH_CONTEXT', 'detail': CASE WHEN n_growth_misses > 0 THEN '不在增长语境中：' || growth_misses END},
    {'code': 'KEYWORD_SHORT', 'detail': CASE WHEN short THEN format('“{}”只有 {} 个字', matched_keyword, length(matched_keyword)) END},
    {'code': 'KEYWORD_GENERIC', 'detail': CASE WHEN generic THEN format('“{}”出现 {} 次，见于 {}/{} 份文档', matched_keyword, n_found, n_sources, total_sources) END},
    {'code': 'WEAK_MATCH_DOWNGRADED', 'detail': CASE WHEN weak THEN format('仅靠{}的关键词“{}”，无数字或引号专名佐证', concat_ws('/', CASE WHEN short THEN '过短' END, CASE WHEN generic THEN '高频通用' END), matched_keyword) END},
    {'code': 'NO_EVIDENCE', 'detail': CASE WHEN refuted THEN format('“{}”虽出现，但数字均未找到', matched_keyword) END}], lambda x: x.detail IS NOT NULL)) AS w FROM ruled WHERE found)"""
_TERMS = f"""ex AS (SELECT claim_id, t, min((-length(t), i)) AS o FROM (SELECT claim_id, {S.trim('t')} AS t, i FROM (SELECT claim_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT claim_id, list_concat(coalesce(numbers, []), coalesce(entities, [])) AS l FROM asked))) WHERE t <> '' GROUP BY claim_id, t),
  exo AS (SELECT claim_id, t, row_number() OVER (PARTITION BY claim_id ORDER BY o) AS i FROM ex),
  cwords AS (SELECT DISTINCT claim_id, unnest(regexp_extract_all(claim_text, '[一-鿿]{{2,6}}')) AS t FROM asked), cwo AS (SELECT claim_id, t, row_number() OVER (PARTITION BY claim_id ORDER BY length(t) DESC, t) AS i FROM cwords),
  kept AS (SELECT * FROM cwo c WHERE NOT EXISTS (SELECT 1 FROM exo WHERE exo.claim_id = c.claim_id AND contains(exo.t, c.t)) AND NOT EXISTS (SELECT 1 FROM cwo d WHERE d.claim_id = c.claim_id AND d.i < c.i AND contains(d.t, c.t))),
  tt AS (SELECT claim_id, 0 AS part, 0 AS i, {S.trim('substr(claim_text, 1, 60)')} AS t FROM asked WHERE {S.trim('substr(claim_text, 1, 60)')} <> '' UNION ALL SELECT claim_id, 1, i, t FROM exo UNION ALL SELECT claim_id, 2, i, t FROM kept),
  terms AS (SELECT claim_id, t AS term, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY part, i) - 1 AS INTEGER) AS term_pos FROM tt)"""
_RANK = f"""ph AS (SELECT term, chunk_id, {S.count_of('lower(text)', 'lower(term)')} AS tf, {S.count_of('text', 'term')} AS ex, greatest(length(text) - 2, 0) AS size FROM (SELECT DISTINCT term FROM terms) JOIN once ON contains(lower(text), lower(term))),
  st AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS mean_size FROM once), df AS (SELECT term, count(*) AS nt FROM ph GROUP BY term),
  bm AS (SELECT ph.term, chunk_id, CASE WHEN ln((n - nt + 0.5) / (nt + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nt + 0.5) / (nt + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size)) AS score FROM ph JOIN df USING (term), st WHERE length(replace(term, ' ', '')) >= 3),
  bmr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= {L.TERM_LIMIT}),
  lk AS (SELECT * FROM (SELECT term, chunk_id, CAST(ex AS DOUBLE) AS score, row_number() OVER (PARTITION BY term ORDER BY ex DESC, chunk_id) AS rank FROM ph WHERE length(replace(term, ' ', '')) < 3) WHERE rank <= {L.TERM_LIMIT})"""
_SEARCH = f"{S.QUERY_SET}, {S.CHUNKS}, {_TERMS}, {_RANK}"
_FUSED = f"""fu AS (SELECT claim_id, chunk_id, sum(CASE WHEN term_pos = 0 THEN {L.CLAIM_WEIGHT} ELSE 1.0 END / ({L.RRF_K} + rank)) AS score, min((term_pos, rank)) AS first FROM terms JOIN ranked USING (term) GROUP BY claim_id, chunk_id),
  pe AS (SELECT fu.*, EXISTS (SELECT 1 FROM exo WHERE exo.claim_id = fu.claim_id) AND NOT EXISTS (SELECT 1 FROM exo WHERE exo.claim_id = fu.claim_id AND contains(once.text, exo.t)) AS penalised FROM fu JOIN once USING (chunk_id)),
  sc AS (SELECT claim_id, chunk_id, penalised, first, CASE WHEN penalised THEN score * {L.PENALTY} ELSE score END AS score FROM pe)"""

_BEST = f"SELECT claim_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 12) DESC, first, chunk_id) AS rank FROM sc) WHERE rank <= {L.TOP_K}"
_RANKED = "ranked AS (SELECT term, chunk_id, rank FROM bmr UNION ALL SELECT term, chunk_id, rank FROM lk)"
_RETRIEVED = f"""{S.QUERY_SET}, {S.DOCS}, {_KW}, {_TERMS}, {_RANK}, {_RANKED}, {_FUSED}, cand AS ({_BEST}), {_PLAIN},
  rm AS (SELECT claim_id, min((rank, pos, k, chunk_id)) AS b FROM cand JOIN kw ON kw.id = claim_id JOIN once USING (chunk_id) WHERE contains(once.text, k) GROUP BY claim_id),
  mm AS (SELECT claim_id, b[3] AS keyword, source_path FROM rm JOIN once ON once.chunk_id = b[4] UNION ALL SELECT claim_id, b[3], b[2] FROM m0 WHERE claim_id NOT IN (SELECT claim_id FROM rm)),
  m AS (SELECT claim_id, keyword, docs.source_path, docs.source, docs.text FROM mm JOIN docs USING (source_path))"""

SQL = {
    "match_first": f"WITH {_MATCH} SELECT claim_id, keyword, source_path, source FROM m",
    "snippet_context": f"WITH {_MATCH} SELECT claim_id, keyword, replace(substr(text, greatest(instr(text, keyword) - {L.SNIPPET_RADIUS}, 1), instr(text, keyword) + length(keyword) + {L.SNIPPET_RADIUS} - greatest(instr(text, keyword) - {L.SNIPPET_RADIUS}, 1)), chr(10), ' ') AS snippet FROM m",
    "subclaim_semi": f"WITH {_BASE}, {_CLAUSES} SELECT * EXCLUDE (supported) FROM support WHERE supported",
    "subclaim_anti": f"WITH {_BASE}, {_CLAUSES} SELECT * EXCLUDE (supported) FROM support WHERE NOT supported",
    "entity_coverage": f"WITH {S.EVERY}, {S.DOCS}, {_COVER} SELECT *, round(n_covered * 100 / n_entities, 6) AS coverage FROM cov",
    "missing_numbers": f"WITH {S.EVERY}, {S.DOCS}, {_NUMS} SELECT DISTINCT claim_id, number FROM np WHERE NOT present",
    "cooccurrence_range": f"WITH {_MATCH}, {_VALID}, {_MIS} SELECT * FROM mis",
    "growth_context": f"WITH {S.EVERY}, {S.DOCS}, {_GROWTH} SELECT * FROM gc",
    "keyword_generality": f"WITH {_MATCH}, {_GENERAL} SELECT * FROM kg",
    "claim_status": f"WITH {_MATCH}, {_FACTS}, {_RULES} SELECT {', '.join(_STATUS)}, codes FROM ruled",
    "claim_warnings": f"WITH {_MATCH}, {_FACTS}, {_RULES} {_WARNED}",
    "claim_status_retrieved": f"WITH {_RETRIEVED}, {_FACTS}, {_RULES} SELECT {', '.join(_STATUS)}, codes FROM ruled",
    "status_cascade": f"""WITH facts AS (SELECT * FROM (VALUES (true), (false)) a(found), (VALUES (0), (1), (2)) b(n_clauses), (VALUES (0), (2)) c(n_supported), (VALUES (0), (1), (2)) d(n_entities), (VALUES (0.0), (50.0), (100.0)) e(coverage),
      (VALUES (0), (1)) f(n_misattributed), (VALUES (0), (2)) g(n_numbers), (VALUES (0), (1), (2)) h(n_missing), (VALUES (0), (1)) i(n_growth_misses), (VALUES (true), (false)) j(short), (VALUES (true), (false)) k(generic), (VALUES (true), (false)) l(quoted_found)), {_RULES}
      SELECT found, CAST(n_clauses AS BIGINT) AS n_clauses, CAST(n_supported AS BIGINT) AS n_supported, CAST(n_entities AS BIGINT) AS n_entities, CAST(coverage AS DOUBLE) AS coverage, CAST(n_misattributed AS BIGINT) AS n_misattributed,
        CAST(n_numbers AS BIGINT) AS n_numbers, CAST(n_missing AS BIGINT) AS n_missing, CAST(n_growth_misses AS BIGINT) AS n_growth_misses, short, generic, quoted_found, status, codes FROM ruled""",
    "search_terms": f"WITH {S.EVERY}, {_TERMS} SELECT claim_id, term_pos, term FROM terms",
    "bm25_phrase_rank": f"WITH {_SEARCH} SELECT term, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bmr",
    "like_rank": f"WITH {_SEARCH} SELECT term, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lk",
    "rrf_fusion": f"WITH {_SEARCH}, {_RANKED}, {_FUSED} {_BEST}",
    "anchor_penalty": f"WITH {_SEARCH}, {_RANKED}, {_FUSED} SELECT claim_id, penalised, count(*) AS n_chunks, round(max(score), 6) AS best FROM sc GROUP BY claim_id, penalised",
}
