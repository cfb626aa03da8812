"""The queries of the eight problems, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from ..sources.tables import table
from .leakage import bare_map, leaked_items
from .name_variants import linked_names, variant_pairs
from .packing import CAPACITY, byte_sized, pack_items, windows
from .repetition import BLANKS, ENDS, GRAM, LIMIT, LINE_SHARE, SEPARATORS, SHORT, clean_lines
from .same_look import look_sql, same_look_pairs
from .shared_spans import shared_spans
from .splitting import split_items
from .term_counts import TermStore, latest_texts, marked_terms, pair_deltas, value_deltas

Query = Callable[[SparkSession, str], DataFrame]

#: Kinds of record of problem 1, in the order of their codes.
KINDS = ("chunk", "claim", "snippet")


def _text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record = id * 4 + code of its kind, origin, text."""
    chunks, checks, refs = (table(spark, sf_dir, n) for n in ("chunks", "checklist_result", "ref_docs"))
    paths = refs.groupBy("source").agg(F.min("source_path").alias("origin"))
    key = lambda name, code: (F.col(name) * 4 + code).alias("record")
    snippets = checks.filter("source is not null and snippet is not null").select("claim_id", "source", "snippet").join(paths, "source", "left")
    return (
        chunks.select(key("chunk_id", 0), F.col("source_path").alias("origin"), "text")
        .unionByName(checks.select(key("claim_id", 1), F.col("target_path").alias("origin"), F.col("claim_text").alias("text")))
        .unionByName(snippets.select(key("claim_id", 2), F.coalesce("origin", "source").alias("origin"), F.col("snippet").alias("text")))
    )


def _kind_and_id(df: DataFrame, *rest: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("record") % 4 + 1).cast("int"))
    return df.select(kind.alias("rec_kind"), F.expr("record div 4").alias("rec_id"), *rest)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with 50 or more characters in a row that also stand in a record of another origin."""
    return _kind_and_id(shared_spans(_text_records(spark, sf_dir)))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with their shared spans, and number and share of shared characters."""
    found = shared_spans(_text_records(spark, sf_dir))
    spans = F.concat_ws(" ", F.transform("spans", lambda s: F.concat_ws("-", s.cast("array<string>")))).alias("spans")
    return _kind_and_id(found, "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"), spans)


#: Shares of a field's records beyond which a term is common.
COMMON = {"matched_keyword": 0.01, "text": 0.2}


def _term_counts(spark: SparkSession, sf_dir: str, name: str) -> TermStore:
    """The store of that name, brought up to date. A new one is filled as it would have grown: first with what was
    loaded in the first nine tenths of the loading period, then with what was added or changed after that. A later call
    finds the store that an earlier one left, and counts only what differs from it."""
    fields = {"matched_keyword": ("checklist_result", "claim_id", "matched_keyword", "checked_ts", value_deltas), "text": ("chunks", "chunk_id", "text", "loaded_ts", pair_deltas)}
    store = TermStore(spark, f"{shared_dir(spark)}/veritrail-terms/{name}")
    rows = {field: table(spark, sf_dir, name).select(key, text, ts) for field, (name, key, text, ts, _) in fields.items()}
    if not store.version:
        early = {}
        for field, (_, key, text, ts, count) in fields.items():
            low, high = rows[field].agg(F.min(ts).cast("double"), F.max(ts).cast("double")).first()
            until = (low or 0) + ((high or 0) - (low or 0)) * 0.9
            early[field] = (latest_texts(rows[field].filter(F.col(ts).isNull() | (F.col(ts).cast("double") <= until)), key, text, ts), count)
        store = store.update(early)
    return store.update({field: (latest_texts(rows[field], key, text, ts), count) for field, (_, key, text, ts, count) in fields.items()})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and adjacent pairs of ideographs that are too rare or too common, with their mark; by a store of its own
    for each call, so that each call counts everything."""
    return marked_terms(_term_counts(spark, sf_dir, uuid.uuid4().hex).read(), COMMON).filter("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every value and pair, with marks, from the store of the data folder: a second call
    counts only what has changed."""
    return marked_terms(_term_counts(spark, sf_dir, hashlib.md5(sf_dir.encode()).hexdigest()).read(), COMMON).withColumn("share", F.round("share", 9))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks that can't be cut at natural boundaries only."""
    items = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("item_id"), "text")
    return split_items(items).filter("piece_no = 0 and not natural").select(F.col("item_id").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of oversized chunks, with path and own offset."""
    chunks = table(spark, sf_dir, "chunks").filter(F.length("text") > 600).select(F.col("chunk_id").alias("item_id"), "source_path", "chunk_offset", "text").dropDuplicates(["item_id"])
    pieces = split_items(chunks).drop("natural")
    places = chunks.select("item_id", "source_path", "chunk_offset")
    return pieces.join(places, "item_id").select(F.col("item_id").alias("chunk_id"), "source_path", "piece_no", (F.col("chunk_offset") + F.col("start")).alias("chunk_offset"), F.col("piece").alias("text"), "cut")


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any pieces: each begins with the overlap, none is too long, and without the overlaps they spell the
    chunk again."""
    pieces = p4_pieces(spark, sf_dir).withColumn("_end", F.col("chunk_offset") + F.length("text"))
    before = F.lag("_end").over(W.partitionBy("chunk_id").orderBy("piece_no"))
    pieces = pieces.withColumn("_new", F.when(F.col("piece_no") == 0, F.length("text")).otherwise(F.col("_end") - before)).withColumn("_over", F.length("text") - F.col("_new"))
    own = F.expr("right(text, _new)")
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda s: s["own"]))
    full = F.when(F.col("piece_no") > 0, F.col("_over") == F.least(F.lit(150), before - F.min("chunk_offset").over(W.partitionBy("chunk_id")))).otherwise(True)
    pieces = pieces.withColumn("_full", full)
    return pieces.groupBy("chunk_id").agg(F.md5(whole).alias("text_md5"), (F.max(F.length("text")) <= 600).alias("within"), F.every("_full").alias("overlaps"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n: the distinct strings in entities and bylines, and how often they stand there."""
    typed = table(spark, sf_dir, "checklist_result").select(F.explode("entities").alias("name"))
    bylines = table(spark, sf_dir, "chunks").filter(F.col("text").contains("【供稿：")).select(F.explode(F.regexp_extract_all("text", F.lit("【供稿：([^】]*)】"), F.lit(1))).alias("name"))
    return typed.unionByName(bylines).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different strings that name the same person or organisation."""
    return variant_pairs(materialize(linked_names(_names(spark, sf_dir)), "linked"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each string that names somebody, with the entity that it names."""
    return linked_names(_names(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks, claims and names that look the same but differ in stored characters."""
    item = lambda df, field, key, text: df.select(F.lit(field).alias("field"), F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    chunks = item(table(spark, sf_dir, "chunks"), "chunk_text", "chunk_id", "text")
    claims = item(table(spark, sf_dir, "checklist_result"), "claim_text", "claim_id", "claim_text")
    names = item(_names(spark, sf_dir), "name", "name", "name")
    return same_look_pairs(chunks.unionByName(claims).unionByName(names))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(byte_sized(table(spark, sf_dir, "documents").select("doc_id", "text", "n_tokens")), CAPACITY)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, by size in tokens, in containers of 4,096 tokens; a missing size is worked out from the text."""
    return _packed(spark, sf_dir).select("container_id", F.col("item_id").alias("doc_id"), "part_no", "part_offset", F.col("size").alias("tokens"), F.col("fill").alias("container_tokens"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: each document with all its tokens, divided only if larger than a container, no
    container beyond its capacity."""
    rows = _packed(spark, sf_dir).withColumn("_filled", F.sum("size").over(W.partitionBy("container_id")))
    return rows.groupBy(F.col("item_id").alias("doc_id")).agg(F.sum("size").alias("tokens"), (F.count(F.lit(1)) > 1).alias("divided"), (F.max("_filled") <= CAPACITY).alias("within"))


def p6_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens packed, and whether the containers are at most 2 % (and two) more than their tokens need."""
    rows = _packed(spark, sf_dir).agg(F.sum("size").alias("tokens"), F.count_distinct("container_id").alias("_made"))
    return rows.select("tokens", (F.col("_made") <= F.col("tokens") / CAPACITY * 1.02 + 2).alias("little_left"))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers as sequences of token ids: number of documents and tokens, digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_tokens")
    rows = windows(_packed(spark, sf_dir), docs)
    return rows.select("container_id", "n_parts", F.size("tokens").alias("n_tokens"), F.md5(F.concat_ws(",", F.col("tokens").cast("array<string>"))).alias("digest"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items of which at least half leaked into them."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the item's letters, digits and ideographs and how many of them leaked."""
    items = table(spark, sf_dir, "gold_annotations").select("item_id", F.col("claim_text").alias("text"))
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that line-first cleaning rejects for the text they lose to repetition."""
    docs = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), cleaned=False)
    return docs.filter("rejected").select("doc_id").distinct()


def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document what the line rules remove, the share that repeats itself, and a digest of the cleaned text."""
    docs = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    share = F.round(F.col("repeated_chars") / F.greatest(F.col("n_chars"), F.lit(1)), 6)
    return docs.select(*docs.columns[:-1], share.alias("repeated_share"), F.length("cleaned").alias("kept_chars"), F.md5("cleaned").alias("cleaned_md5"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_entities, p3_found, p3_counts, p4_found, p4_pieces, p4_rebuilt, p5_found, p6_packed, p6_totals, p6_space, p6_windows, p7_found, p7_leaks, p8_found, p8_lines)}


_P1 = """
  WITH refs AS (SELECT source, min(source_path) AS path FROM ref_docs GROUP BY source),
  r AS (SELECT 'chunk' AS rec_kind, chunk_id AS rec_id, source_path AS origin, text FROM chunks UNION SELECT 'claim', claim_id, target_path, claim_text FROM checklist_result
    UNION SELECT 'snippet', claim_id, coalesce(path, c.source), snippet FROM checklist_result c LEFT JOIN refs ON refs.source = c.source WHERE c.source IS NOT NULL AND snippet IS NOT NULL),
  w AS (SELECT rec_kind, rec_id, origin, length(text) AS n, unnest(range(1, length(text) - 48)) AS i, unnest(list_transform(range(1, length(text) - 48), lambda i: substr(text, i, 50))) AS g FROM r WHERE length(text) >= 50),
  s AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT origin) > 1), f AS (SELECT * FROM w SEMI JOIN s USING (g))"""
_P3 = """
  WITH k AS (SELECT DISTINCT claim_id, matched_keyword AS term FROM checklist_result WHERE matched_keyword <> ''), c AS (SELECT DISTINCT chunk_id, text FROM chunks),
  p AS (SELECT chunk_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS term FROM c),
  g AS (SELECT chunk_id, term, count(*) AS n FROM p WHERE regexp_full_match(term, '[\\x{4E00}-\\x{9FFF}]{2}') GROUP BY ALL),
  t AS (SELECT 'matched_keyword' AS field, term, count(*) AS occurrences, count(*) AS records, (SELECT count(*) FROM k) AS total, 0.01 AS most FROM k GROUP BY term
    UNION ALL SELECT 'text', term, CAST(sum(n) AS BIGINT), count(*), (SELECT count(*) FROM c), 0.2 FROM g GROUP BY term),
  m AS (SELECT field, term, occurrences, records, round(records / total, 9) AS share, CASE WHEN records / total > most THEN 'common' WHEN records = 1 THEN 'rare' END AS mark FROM t)"""
_P8 = """
  WITH w AS (SELECT doc_id, unnest(range(1, length(text) - 8)) AS i, unnest(list_transform(range(1, length(text) - 8), lambda i: substr(text, i, 10))) AS g FROM documents WHERE length(text) >= 10),
  a AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS n FROM w) WHERE n > 1),
  h AS (SELECT doc_id, count(DISTINCT at_char) AS hit FROM (SELECT doc_id, unnest(range(i, i + 10)) AS at_char FROM a) GROUP BY doc_id)"""


_P6 = "s AS (SELECT doc_id, CAST(max(coalesce(n_tokens, strlen(text) + 1)) AS BIGINT) AS tokens FROM documents GROUP BY doc_id)"
# behind what a boundary ends with, and in front of what doesn't continue it
_P4 = """c AS (SELECT DISTINCT chunk_id, text, length(text) AS n FROM chunks WHERE length(text) > 600), q AS (SELECT chunk_id, text, n, unnest(range(1, n)) AS p FROM c),
  e AS (SELECT chunk_id, p, left(text, p) AS front, substr(text, p + 1, 1) AS next FROM q WHERE contains('。！？…' || chr(10) || chr(13) || chr(9) || ' ', substr(text, p, 1))),
  b AS (SELECT chunk_id, p FROM e WHERE (right(front, 2) = chr(10) || chr(10) AND next <> chr(10))
    OR (regexp_matches(front, '[。！？…][\\n\\r]*$') AND next <> chr(10) AND next <> chr(13) AND NOT (contains('。！？…', next) AND contains('。！？…', right(front, 1))))
    OR (regexp_matches(front, '[.!?][ \\t\\n\\r]+$') AND NOT contains(' ' || chr(9) || chr(10) || chr(13), next)) UNION SELECT chunk_id, n FROM c)"""
_P7_MAP = bare_map()
_P7 = f"""
  WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION SELECT 'i', item_id, claim_text FROM gold_annotations WHERE claim_text IS NOT NULL),
  b AS MATERIALIZED (SELECT side, id, regexp_replace({_P7_MAP("text")}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS bare FROM t),
  i AS (SELECT id AS item_id, length(bare) AS n, unnest(range(1, length(bare) - 14)) AS o, unnest(list_transform(range(1, length(bare) - 14), lambda i: substr(bare, i, 16))) AS g FROM b WHERE side = 'i' AND length(bare) >= 16),
  d AS (SELECT DISTINCT id AS doc_id, unnest(list_transform(range(1, length(bare) - 14), lambda i: substr(bare, i, 16))) AS g FROM b WHERE side = 'd' AND length(bare) >= 16),
  h AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(o, o + 16)) AS c FROM d JOIN i USING (g)),
  l AS (SELECT doc_id, item_id, n AS item_chars, count(*) AS leaked_chars FROM h GROUP BY ALL HAVING 2 * count(*) >= n)"""
_CLASS = lambda codes: "[" + "".join(f"\\x{{{c:X}}}" for c in codes) + "]"
_P8_LINES = f"""{_P8},
  s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text <> ''),
  l0 AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS no, len(parts) AS m FROM s),
  l1 AS (SELECT doc_id, no, body || CASE WHEN no < m THEN chr(10) ELSE '' END AS line FROM l0 WHERE no < m OR body <> ''),
  l2 AS (SELECT *, length(line) AS size, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM l1),
  hc AS (SELECT DISTINCT doc_id, unnest(range(i, i + {GRAM})) AS at_char FROM a),
  r AS (SELECT l2.doc_id, no, count(*) AS repeated FROM hc ASOF JOIN l2 ON hc.doc_id = l2.doc_id AND hc.at_char <= l2.upto GROUP BY ALL),
  f AS (SELECT l2.*, coalesce(repeated, 0) AS repeated, regexp_replace(line, '{_CLASS(BLANKS)}+$', '') AS shown FROM l2 LEFT JOIN r ON r.doc_id = l2.doc_id AND r.no = l2.no),
  g AS (SELECT *, repeated > 0 AND repeated >= {LINE_SHARE} * size AS bo, shown <> '' AND NOT regexp_matches(right(shown, 1), '{_CLASS(map(ord, ENDS))}') AS pu,
    shown <> '' AND size <= {SHORT} AND length(regexp_replace(line, '[^{_CLASS(map(ord, SEPARATORS))[1:-1]}]', '', 'g')) >= 2 AS na FROM f),
  k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bo) AS b, count(*) FILTER (WHERE pu) AS p, count(*) FILTER (WHERE na) AS n, coalesce(sum(size) FILTER (WHERE bo), 0) AS bc, coalesce(sum(size) FILTER (WHERE bo OR pu OR na), 0) AS lc,
    sum(repeated) AS rc, coalesce(string_agg(line, '' ORDER BY no) FILTER (WHERE NOT (bo OR pu OR na)), '') AS cleaned FROM g GROUP BY doc_id),
  z AS (SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(b, 0) AS INTEGER) AS boilerplate_lines, CAST(coalesce(p, 0) AS INTEGER) AS punctuation_lines, CAST(coalesce(n, 0) AS INTEGER) AS navigation_lines,
    CAST(coalesce(bc, 0) AS BIGINT) AS boilerplate_chars, CAST(coalesce(lc, 0) AS BIGINT) AS lost_chars, CAST(coalesce(rc, 0) AS BIGINT) AS repeated_chars, coalesce(cleaned, '') AS cleaned FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id)"""
def oracle_sql() -> dict[str, str]:
    """Problems 2, 5, 6 and 7 have none: components, look-alike tables, packing and compatibility forms
    are no SQL of the oracle's; their tests hold them against brute force."""
    return {
        "p1_found": f"{_P1} SELECT DISTINCT rec_kind, rec_id FROM f",
        "p1_shares": f"""{_P1}, u AS (SELECT DISTINCT rec_kind, rec_id, n, i FROM f), v AS (SELECT *, CASE WHEN i <= lag(i) OVER x + 50 THEN 0 ELSE 1 END AS fresh FROM u WINDOW x AS (PARTITION BY rec_kind, rec_id ORDER BY i)),
          y AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_kind, rec_id ORDER BY i) AS island FROM v), z AS (SELECT rec_kind, rec_id, n, island, min(i) - 1 AS a, max(i) + 49 AS b FROM y GROUP BY ALL)
          SELECT rec_kind, rec_id, CAST(n AS INTEGER) AS n_chars, CAST(sum(b - a) AS BIGINT) AS shared_chars, round(sum(b - a) / n, 6) AS shared_share, string_agg(a || '-' || b, ' ' ORDER BY a) AS spans FROM z GROUP BY rec_kind, rec_id, n""",
        "p3_found": f"{_P3} SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
        "p3_counts": f"{_P3} SELECT * FROM m",
        "p4_found": f"""WITH RECURSIVE {_P4}, reach AS (SELECT chunk_id, CAST(0 AS BIGINT) AS p FROM c UNION SELECT b.chunk_id, b.p FROM reach r JOIN b ON b.chunk_id = r.chunk_id AND b.p > r.p AND b.p - greatest(r.p - 150, 0) <= 600)
          SELECT chunk_id FROM c WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.chunk_id = c.chunk_id AND reach.p = c.n)""",
        "p4_rebuilt": f"WITH {_P4} SELECT chunk_id, md5(text) AS text_md5, true AS within, true AS overlaps FROM c",
        "p5_found": f"""WITH names AS (SELECT DISTINCT name FROM (SELECT unnest(entities) AS name FROM checklist_result UNION ALL SELECT unnest(regexp_extract_all(text, '【供稿：([^】]*)】', 1)) FROM chunks) WHERE name <> ''),
          texts AS (SELECT DISTINCT 'chunk_text' AS field, CAST(chunk_id AS VARCHAR) AS item, text FROM chunks WHERE text IS NOT NULL UNION SELECT 'claim_text', CAST(claim_id AS VARCHAR), claim_text FROM checklist_result WHERE claim_text IS NOT NULL UNION ALL SELECT 'name', name, name FROM names),
          looks AS MATERIALIZED ({look_sql(keep="field, item, text")})
          SELECT DISTINCT a.field, a.item AS key_a, b.item AS key_b FROM looks a JOIN looks b ON a.field = b.field AND a.look = b.look AND a.item < b.item AND a.text <> b.text""",
        "p6_totals": f"WITH {_P6} SELECT doc_id, tokens, tokens > {CAPACITY} AS divided, true AS within FROM s WHERE tokens > 0",
        "p6_space": f"WITH {_P6} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, true AS little_left FROM s",
        "p7_found": f"{_P7} SELECT doc_id, item_id FROM l",
        "p7_leaks": f"{_P7} SELECT * FROM l",
        "p8_lines": f"{_P8_LINES} SELECT * EXCLUDE (cleaned), n_chars > 0 AND repeated_chars >= {LIMIT} * n_chars AS rejected, round(repeated_chars / greatest(n_chars, 1), 6) AS repeated_share, length(cleaned) AS kept_chars, md5(cleaned) AS cleaned_md5 FROM z",
        "p8_found": f"{_P8} SELECT d.doc_id FROM documents d JOIN h ON h.doc_id = d.doc_id WHERE hit >= 0.3 * length(text)",
    }
