"""Queries on texts and what stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import chunking, claims
from ..sources import checks, documents, words
from . import sql as S


def _pattern(spark: SparkSession, sf_dir: str) -> str:
    return T.category_pattern(claims.category_words(words(spark, sf_dir)))


def _claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir, "claim_id", "claim_text").drop("status", "checked_ts")


def claims_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.split_claims(documents(spark, sf_dir, "doc_id", "text"), "doc_id")


def claim_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims_split(spark, sf_dir).select(F.when(F.size(T.numbers(F.col("claim_text"))) > 0, "定量").otherwise("定性").alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_claims"))


def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_texts(spark, sf_dir).select("claim_id", F.posexplode(T.numbers(F.col("claim_text"))).alias("ord", "number"))


def entities_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.entities(F.col("claim_text"), _pattern(spark, sf_dir))
    return _claim_texts(spark, sf_dir).select("claim_id", F.posexplode(names).alias("ord", "entity"))


def entity_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = checks(spark, sf_dir, "claim_id", "entities").select("claim_id", F.explode("entities").alias("entity"))
    return named.select("claim_id", "entity", T.names_something(F.col("entity")).alias("valid"))


def subclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _claim_texts(spark, sf_dir).select("claim_id", F.posexplode(T.clauses(F.col("claim_text"), _pattern(spark, sf_dir))).alias("no", "c"))
    return parts.select("claim_id", "no", F.col("c.text").alias("part"), "c.independent", F.size("c.numbers").alias("n_numbers"))


def subclaim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = subclaims(spark, sf_dir).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if("independent").alias("n_independent"))
    return per.groupBy("n_parts", "n_independent").agg(F.count(F.lit(1)).alias("n_claims"))


def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_texts(spark, sf_dir).select("claim_id", F.posexplode(T.keywords(F.col("claim_text"))).alias("pos", "keyword"))


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_texts(spark, sf_dir).select("claim_id", F.posexplode(T.content_words(F.col("claim_text"))).alias("pos", "word"))


def attribute_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir, "claim_id", "claim_text", "entities").select("claim_id", "claim_text", F.explode(F.array_distinct("entities")).alias("entity"))
    return rows.select("claim_id", "entity", F.explode(T.attribute_words(F.col("claim_text"), F.col("entity"))).alias("word"))


def offline_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = claims.describe_claims(claims_split(spark, sf_dir), _pattern(spark, sf_dir))
    return claims.offline_claims(described).select("doc_id", "pos", "kind", "claim_text", F.size("numbers").alias("n_numbers"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.prompt_texts(documents(spark, sf_dir, "doc_id", "text"), "doc_id").select("doc_id", "part_no", F.length("part").alias("n_chars"), F.md5("part").alias("digest"))


def chunks_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_texts(documents(spark, sf_dir, "doc_id", "text"), "doc_id")


QUERIES = (claims_split, claim_kind_counts, numbers_extract, entities_quoted, entity_noise_filter, subclaims, subclaim_counts, keywords_topk, content_words, attribute_words, offline_claims, prompt_texts, chunks_boundary)

_SPLIT = f"""parts AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[。；\\n]+') AS a FROM documents)),
  sentences AS (SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, {S.trim('part')} AS claim_text FROM parts
    WHERE length({S.trim('part')}) > 10 AND NOT regexp_matches({S.trim('part')}, '^[\\s\\p{{Z}}\\p{{Nd}}.、）)]+$') GROUP BY doc_id, claim_text)"""
_TEXTS = S.CLAIMS + ", src AS (SELECT claim_id AS id, claim_text AS txt FROM claims)"
_ENTITIES = f"""e0 AS (SELECT id, {S.entity_list('txt')} AS a FROM src, cat),
  e1 AS (SELECT id, unnest(a) AS e, generate_subscripts(a, 1) AS i FROM e0), ents AS (SELECT id, e, min(i) AS i FROM e1 GROUP BY id, e)"""

# greedy packing: parts so far in one string, the last part behind the last separator
_PROMPT = """ps AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim}), lambda x: x <> '') AS ps FROM documents),
  jo AS (SELECT doc_id, list_reduce(ps, lambda a, p: CASE WHEN length(list_last(string_split(a, chr(30)))) + length(p) > 3500 THEN a || chr(30) || p ELSE a || chr(10) || p END) AS joined FROM ps WHERE len(ps) > 0),
  pa AS (SELECT doc_id, string_split(joined, chr(30)) AS parts FROM jo)""".format(trim=S.trim("x"))
# windows: the last boundary of the best kind within the target, else the next one; kinds 1 to 3, the end of the text counts as 1
_CHUNK = """dc AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''), dq AS (SELECT doc_id, text, unnest(range(1, n)) AS p FROM dc),
  de AS (SELECT doc_id, p, left(text, p) AS front, substr(text, p + 1, 1) AS next FROM dq WHERE contains('。！？…' || chr(10) || chr(13) || chr(9) || ' ', substr(text, p, 1))),
  db AS (SELECT doc_id, p, CASE WHEN right(front, 2) = chr(10) || chr(10) AND next <> chr(10) THEN 1 WHEN regexp_matches(front, '[。！？…][\\n\\r]*$') AND next <> chr(10) AND next <> chr(13) AND NOT (contains('。！？…', next) AND contains('。！？…', right(front, 1))) THEN 2
    WHEN regexp_matches(front, '[.!?][ \\t\\n\\r]+$') AND NOT contains(' ' || chr(9) || chr(10) || chr(13), next) THEN 3 END AS kind FROM de UNION ALL SELECT doc_id, n, 1 FROM dc),
  bl AS MATERIALIZED (SELECT doc_id, list((p, kind) ORDER BY p) AS ends FROM db WHERE kind IS NOT NULL GROUP BY doc_id),
  wi AS (SELECT dc.doc_id, 0 AS start, n, ends, {end0} AS e FROM dc JOIN bl USING (doc_id)
    UNION ALL SELECT doc_id, s, n, ends, {end1} FROM (SELECT doc_id, n, ends, CASE WHEN e - 150 > start THEN e - 150 ELSE e END AS s FROM wi WHERE e < n))"""
_END = "coalesce((list_sort(list_transform(list_filter(ends, lambda x: x[1] > {s} AND x[1] <= {s} + 600), lambda x: (x[2], -x[1])))[1])[2] * -1, list_filter(ends, lambda x: x[1] > {s})[1][1])"
_CHUNK = _CHUNK.format(end0=_END.format(s="0"), end1=_END.format(s="s"))

SQL = {
    "prompt_texts": f"WITH {_PROMPT} SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part_no, CAST(length(unnest(parts)) AS INTEGER) AS n_chars, md5(unnest(parts)) AS digest FROM pa",
    "chunks_boundary": f"WITH RECURSIVE {_CHUNK}, ou AS (SELECT w.doc_id, start, substr(text, start + 1, e - start) AS text FROM wi w JOIN dc ON dc.doc_id = w.doc_id) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS offset, text FROM ou WHERE {S.trim('text')} <> ''",
    "claims_split": f"WITH {_SPLIT} SELECT * FROM sentences",
    "claim_kind_counts": f"WITH {_SPLIT} SELECT CASE WHEN regexp_matches(claim_text, '{S.NUMBER}') THEN '定量' ELSE '定性' END AS kind, count(*) AS n_claims FROM sentences GROUP BY 1",
    "numbers_extract": f"WITH {_TEXTS}, {S.numbers('src')} SELECT id AS claim_id, CAST(row_number() OVER (PARTITION BY id ORDER BY length(n) DESC, n) - 1 AS INTEGER) AS ord, n AS number FROM nums",
    "entities_quoted": f"WITH {_TEXTS}, {S.category_cte()}, {_ENTITIES} SELECT id AS claim_id, CAST(row_number() OVER (PARTITION BY id ORDER BY length(e) DESC, i) - 1 AS INTEGER) AS ord, e AS entity FROM ents",
    "entity_noise_filter": f"WITH {S.CLAIMS}, n AS (SELECT claim_id, unnest(entities) AS entity FROM claims) SELECT claim_id, entity, {S.valid_entity('entity')} AS valid FROM n",
    "subclaims": f"WITH {_TEXTS}, {S.category_cte()}, {S.clauses('src')} SELECT id AS claim_id, CAST(no AS INTEGER) AS no, part, independent, CAST(len(list_distinct(regexp_extract_all(part, '{S.NUMBER}'))) AS INTEGER) AS n_numbers FROM clause",
    "subclaim_counts": f"WITH {_TEXTS}, {S.category_cte()}, {S.clauses('src')}, per AS (SELECT id, count(*) AS n_parts, count(*) FILTER (WHERE independent) AS n_independent FROM clause GROUP BY id) SELECT n_parts, n_independent, count(*) AS n_claims FROM per GROUP BY ALL",
    "keywords_topk": f"WITH {_TEXTS}, {S.keywords('src')} SELECT id AS claim_id, CAST(pos AS INTEGER) AS pos, k AS keyword FROM kw",
    "content_words": f"WITH {_TEXTS}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(txt, '[一-鿿]{{2,6}}')) AS word FROM src) SELECT id AS claim_id, CAST(row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, word) - 1 AS INTEGER) AS pos, word FROM w",
    "attribute_words": f"""WITH {S.CLAIMS}, e AS (SELECT DISTINCT claim_id, claim_text, unnest(entities) AS entity FROM claims),
      n AS (SELECT claim_id, entity, instr(claim_text, entity) AS pl, claim_text FROM e),
      r AS (SELECT DISTINCT claim_id, entity, unnest(regexp_extract_all(substr(claim_text, greatest(pl - {L.ATTRIBUTE_WINDOW}, 1), pl + length(entity) + {L.ATTRIBUTE_WINDOW} - greatest(pl - {L.ATTRIBUTE_WINDOW}, 1)), '[一-鿿]{{3,15}}')) AS word FROM n WHERE pl > 0)
      SELECT * FROM r WHERE NOT contains(entity, word)""",
    "offline_claims": f"""WITH {_SPLIT}, {S.category_cte()}, g AS (SELECT *, CAST(len(list_distinct(regexp_extract_all(claim_text, '{S.NUMBER}'))) AS INTEGER) AS n_numbers, len({S.entity_list('claim_text')}) AS n_names FROM sentences, cat)
      SELECT doc_id, pos, CASE WHEN n_numbers > 0 THEN '定量' ELSE '定性' END AS kind, claim_text, n_numbers FROM g WHERE n_numbers > 0 OR n_names > 0 OR regexp_matches(claim_text, '{S.words(L.GATE_VERBS)}')""",
}
