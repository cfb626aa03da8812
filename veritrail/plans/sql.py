"""Pieces of SQL for the oracles, in DuckDB's dialect: the same rules as in functions.text, spelled anew."""

from __future__ import annotations

from ..functions import lexicon as L

SPACE = r"[\s\x{85}\p{Z}]"
UNITS = "|".join(L.UNITS)
NUMBER = rf"[\p{{Nd}}.]+{SPACE}*(?:{UNITS})"
QUOTES = ("“([^“”]{2,50})”", '"([^"]{3,50})"', "《([^《》]{2,50})》")


def words(items: list[str] | tuple[str, ...]) -> str:
    return "(?:" + "|".join(items) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


CLAIMS = "claims AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY checked_ts DESC, status DESC NULLS LAST) AS rn FROM checklist_result) WHERE rn = 1)"
EVERY = CLAIMS + ", asked AS (SELECT * FROM claims)"
QUERY_SET = CLAIMS + ", asked AS (SELECT * FROM claims WHERE claim_id % 100 = 0)"  # of the searches
CHUNKS = "once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_ts DESC) AS rn FROM chunks) WHERE rn = 1)"

# the whole texts: of overlapping chunks the first counts, a gap is newlines
DOCS = CHUNKS + """,
  d0 AS (SELECT source_path, chunk_offset AS o, text, coalesce(max(chunk_offset + length(text)) OVER (PARTITION BY source_path ORDER BY chunk_offset, length(text) DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pe FROM once WHERE text <> ''),
  d1 AS (SELECT source_path, string_agg(repeat(chr(10), greatest(o - pe, 0)) || substr(text, greatest(pe - o, 0) + 1), '' ORDER BY o, length(text) DESC, text) AS text FROM d0 WHERE o + length(text) > pe GROUP BY source_path),
  docs AS MATERIALIZED (SELECT d1.*, n.source FROM d1 JOIN (SELECT source_path, coalesce(max(source), source_path) AS source FROM once GROUP BY source_path) n USING (source_path))"""


def standing(name: str, terms: str) -> str:
    """CTE {name}(term, source_path, text): the whole texts in which each of the terms stands."""
    return f"{name} AS MATERIALIZED (SELECT term, source_path, text FROM (SELECT DISTINCT term FROM ({terms}) WHERE term <> '') JOIN docs ON contains(text, term))"


def numbers(source: str, key: str = "id", text: str = "txt") -> str:
    """CTEs ending in nums(id, n): distinct numbers of a text."""
    return f"nums AS (SELECT DISTINCT {key} AS id, unnest(regexp_extract_all({text}, '{NUMBER}')) AS n FROM {source})"


def category_cte() -> str:
    """cat(p): the pattern of category names, from the built-in words and the table."""
    values = ", ".join(f"('{w}')" for w in L.CATEGORY_WORDS)
    return (
        f"cw AS (SELECT DISTINCT w FROM (SELECT w FROM (VALUES {values}) v(w) UNION SELECT trim(word) FROM category_words WHERE length(trim(word)) >= 2)), "
        "cat AS (SELECT '[一-鿿]{2,30}(?:' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')' AS p FROM cw)"
    )


def entity_list(text: str) -> str:
    """Expression over a row that is joined with cat: names in order, not yet distinct or sorted."""
    quoted = ", ".join(f"regexp_extract_all({text}, '{p}', 1)" for p in QUOTES)
    return f"list_filter(list_transform(list_concat({quoted}, regexp_extract_all({text}, p)), lambda x: {trim('x')}), lambda x: NOT regexp_matches(x, '[，、；。！？,;]'))"


def keywords(source: str, name: str = "kw", key: str = "id", text: str = "txt") -> str:
    """CTEs ending in {name}(id, k, pos): up to eight keywords of a text, pos from 0."""
    pairs = ("“”", "‘’", "「」", "『』", "《》", '""')
    sized = lambda x: f"list_filter(list_transform({x}, lambda x: {trim('x')}), lambda x: length(x) BETWEEN 3 AND 40)"
    lists = [sized(f"regexp_extract_all({text}, '{p[0]}([^{p}]{{2,}}){p[1]}', 1)") for p in pairs]
    lists += [sized(f"regexp_extract_all({text}, '[\\p{{Nd}}.]+{UNITS}')"), sized(f"regexp_extract_all({text}, '{words(L.KEYWORD_VERBS)}[一-鿿]{{2,20}}')")]
    return f"""
      {name}0 AS (SELECT {key} AS id, {text} AS txt, list_concat({', '.join(lists)}) AS a, regexp_extract_all({text}, '[一-鿿]{{4,40}}') AS r FROM {source}),
      {name}1 AS (SELECT id, 0 AS prio, unnest(a) AS k, generate_subscripts(a, 1) AS i FROM {name}0
        UNION ALL SELECT id, 1, k, rn FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY length(k) DESC, i) AS rn FROM (SELECT id, unnest(r) AS k, generate_subscripts(r, 1) AS i FROM {name}0)) WHERE rn <= 5),
      {name}2 AS (SELECT id, k, min((prio, i)) AS o FROM {name}1 GROUP BY id, k),
      {name}3 AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY length(k) DESC, o) - 1 AS pos FROM {name}2),
      {name} AS (SELECT id, k, pos FROM {name}3 WHERE pos < 8
        UNION ALL SELECT id, substr(txt, 1, 20), 0 FROM {name}0 WHERE id NOT IN (SELECT id FROM {name}3) AND {trim('txt')} <> '')"""


def clauses(source: str, key: str = "id", text: str = "txt") -> str:
    """CTEs ending in clause(id, no, part, independent, anchored), for a source that is joined with cat."""
    return f"""
      c0 AS (SELECT {key} AS id, unnest(string_split({text}, '；')) AS part, generate_subscripts(string_split({text}, '；'), 1) AS i FROM {source}),
      c1 AS (SELECT id, i, {trim('part')} AS part FROM c0 WHERE length({trim('part')}) >= 8),
      c2 AS (SELECT id, i, unnest(string_split(part, '，')) AS part, generate_subscripts(string_split(part, '，'), 1) AS j FROM c1),
      c3 AS (SELECT id, i, j, {trim('part')} AS part FROM c2 WHERE length({trim('part')}) >= 8),
      clause AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS no, part,
        regexp_matches(part, '{NUMBER}') OR len({entity_list('part')}) > 0 OR regexp_matches(part, '{words(L.CLAUSE_VERBS)}') AS independent,
        regexp_matches(part, '[\\p{{Nd}}]|[《"“”]|{words(L.ANCHOR_VERBS)}') AS anchored FROM c3, cat)"""


def valid_entity(x: str) -> str:
    starts = "|".join((f"[{L.ORDINALS}][是、]", rf"第[{L.ORDINALS}\p{{Nd}}]阶", *L.CONJUNCTIONS, *L.VERB_PREFIXES, f"[{L.PARTICLES}]"))
    return (
        f"NOT (regexp_matches({x}, '^(?:{starts})') OR regexp_matches({x}, '{'|'.join((*L.PRONOUNS, '不是'))}') OR {trim(x)} = '' "
        f"OR (length({x}) >= 20 AND NOT regexp_matches({x}, '[{L.TITLE_MARKS}]')))"
    )


def count_of(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // length({term}))"


def statuses(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '✓|已确认') THEN 'confirmed' WHEN regexp_matches({x}, '未找到') THEN 'not_found' WHEN regexp_matches({x}, '△|部分|需核实|数据不一致') THEN 'partial' ELSE 'other' END"


