"""Matching claims with evidence and checking the match: one row of facts a claim, then one status.

Evidence is sought in whole reference texts, not in their chunks. All containment questions (keywords, names, numbers,
quoted phrases, sub-claims) are answered by a single join of the distinct terms with the texts; what follows are equi-joins
on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..session import materialize
from .containment import contains_join
from .documents import BEFORE, BEHIND, PIECE, pieces

# Patterns that decide results.
QUOTED = '[“《"]([^”》"]{2,40})[”》"]'
ANCHORED = rf"(?U)[\d０-９]|[《\"“”]|{T.any_of(L.ANCHOR_VERBS)}"
POLICY_LINE = r"(?U)^[-\s]*政策依据[：:]"


def claim_keywords(claims: DataFrame) -> DataFrame:
    """claim_id, keyword, keyword_pos (from 0)."""
    return claims.select("claim_id", F.posexplode(T.keywords(F.col("claim_text"))).alias("keyword_pos", "keyword"))


def claim_entities(claims: DataFrame) -> DataFrame:
    """claim_id, entity, entity_pos: the names that are no pieces of sentences."""
    valid = F.filter(F.coalesce("entities", F.array().cast("array<string>")), T.names_something)
    return claims.select("claim_id", F.posexplode(valid).alias("entity_pos", "entity"))


def claim_numbers(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.posexplode("numbers").alias("number_pos", "number"))


def claim_clauses(claims: DataFrame) -> DataFrame:
    """claim_id, clause_no, clause, anchored: the independent sub-claims."""
    parts = claims.select("claim_id", F.posexplode("sub_claims").alias("clause_no", "clause")).filter("clause.independent")
    return parts.select("claim_id", "clause_no", F.col("clause.text").alias("clause"), F.col("clause.text").rlike(ANCHORED).alias("anchored"))


def clause_keywords(parts: DataFrame) -> DataFrame:
    return parts.filter("anchored").select("claim_id", "clause_no", F.explode(T.keywords(F.col("clause"))).alias("term"))


def claim_quotes(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.explode(T.found(F.col("claim_text"), QUOTED, 1)).alias("phrase"))


def all_terms(claims: DataFrame) -> DataFrame:
    """Every string whose presence in the texts matters to some check."""
    parts = (
        claim_keywords(claims).select(F.col("keyword").alias("term")),
        claim_entities(claims).select(F.col("entity").alias("term")),
        claim_numbers(claims).select(F.col("number").alias("term")),
        clause_keywords(claim_clauses(claims)).select("term"),
        claim_quotes(claims).select(F.col("phrase").alias("term")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def whole_texts(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """The reference texts in pieces (written once), each with as much behind it as the longest term needs."""
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    return materialize(pieces(chunks, behind=max(BEHIND, longest)), "pieces")


def document_hits(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """term, source_path, piece_no, places (from 1, in the whole text), n_found: where terms begin in the whole texts."""
    lead = F.when(F.col("piece_no") == 0, 0).otherwise(BEFORE)
    found = contains_join(terms, texts, "source_path", "piece_no")
    own = F.transform(F.filter("places", lambda p: (p > lead) & (p <= lead + PIECE)), lambda p: p - lead + F.col("piece_no") * PIECE)
    found = found.select("term", "source_path", "piece_no", own.alias("places")).filter("size(places) > 0")
    return found.withColumn("n_found", T.apart(F.col("places"), F.length("term")))


def term_places(hits: DataFrame) -> DataFrame:
    """term, source_path, n_found, place, piece_no: each text that a term stands in, and where it first does."""
    first = F.min(F.struct(F.col("places")[0].alias("place"), "piece_no"))
    return hits.groupBy("term", "source_path").agg(F.sum("n_found").alias("n_found"), first.alias("f")).select("term", "source_path", "n_found", "f.place", "f.piece_no")


def term_facts(placed: DataFrame) -> DataFrame:
    """term, n_found, n_sources, first_source; only terms that stand somewhere. Texts go by their path."""
    return placed.groupBy("term").agg(F.sum("n_found").alias("n_found"), F.count(F.lit(1)).alias("n_sources"), F.min("source_path").alias("first_source"))


def first_match(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, keyword, source_path: the first keyword that stands anywhere, and the first text with it."""
    met = claim_keywords(claims).join(facts.select(F.col("term").alias("keyword"), "first_source"), "keyword")
    best = F.min(F.struct("keyword_pos", F.col("first_source").alias("source_path"), "keyword")).alias("best")
    return met.groupBy("claim_id").agg(best).select("claim_id", "best.keyword", "best.source_path")


def retrieved_match(claims: DataFrame, chunk_hits: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, keyword, source_path: the text of the best-ranked candidate with a keyword, and the first such
    keyword. chunk_hits: term, chunk_id, n_exact."""
    keys = claim_keywords(claims).select("claim_id", "keyword_pos", F.col("keyword").alias("term"))
    met = ranked.select("claim_id", "chunk_id", "rank").join(keys, "claim_id").join(chunk_hits.filter("n_exact > 0").select("term", "chunk_id"), ["term", "chunk_id"])
    best = met.groupBy("claim_id").agg(F.min(F.struct("rank", "keyword_pos", "term", "chunk_id")).alias("best")).select("claim_id", F.col("best.term").alias("keyword"), "best.chunk_id")
    return best.join(chunks.select("chunk_id", "source_path"), "chunk_id").select("claim_id", "keyword", "source_path")


def matches(claims: DataFrame, placed: DataFrame, facts: DataFrame, chunks: DataFrame, texts: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """claim_id, keyword, source_path, source, snippet of the claims with any evidence; what the retrieval found
    (best), where given, goes before the plain search. The snippet is the first place in the whole text."""
    plain = first_match(claims, facts)
    if best is not None:
        plain = best.unionByName(plain.join(best, "claim_id", "left_anti"))
    sources = chunks.groupBy("source_path").agg(F.coalesce(F.max("source"), F.col("source_path")).alias("source"))
    where = plain.select("keyword", "source_path").distinct().join(placed.select(F.col("term").alias("keyword"), "source_path", "piece_no"), ["keyword", "source_path"], "left")
    shown = where.join(texts.select("source_path", "piece_no", "text"), ["source_path", "piece_no"], "left").join(sources, "source_path")
    # a keyword may stand in a chunk only, in characters that an earlier chunk has otherwise
    shown = shown.select("keyword", "source_path", "source", F.coalesce(T.snippet(F.col("text"), F.col("keyword")), F.lit("")).alias("snippet"))
    return plain.join(shown, ["keyword", "source_path"]).select("claim_id", "keyword", "source_path", "source", "snippet")


def clause_support(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, clause_no, clause, anchored, supported: an unanchored clause counts as supported."""
    parts = claim_clauses(claims)
    sourced = clause_keywords(parts).join(facts.select("term"), "term", "left_semi").select("claim_id", "clause_no").distinct().withColumn("hit", F.lit(True))
    return parts.join(sourced, ["claim_id", "clause_no"], "left").select("claim_id", "clause_no", "clause", "anchored", (~F.col("anchored") | F.coalesce("hit", F.lit(False))).alias("supported"))


def entity_coverage(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, n_entities, n_covered, coverage in percent; claims with valid entities only."""
    named = claim_entities(claims).join(facts.select(F.col("term").alias("entity"), F.lit(1).alias("hit")), "entity", "left")
    return named.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count("hit").alias("n_covered")).withColumn("coverage", F.col("n_covered") * 100 / F.col("n_entities"))


def number_presence(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, number_pos, number, present."""
    present = facts.select(F.col("term").alias("number"), F.lit(True).alias("hit"))
    return claim_numbers(claims).join(present, "number", "left").select("claim_id", "number_pos", "number", F.coalesce("hit", F.lit(False)).alias("present"))


def misattributed(claims: DataFrame, matched: DataFrame, hits: DataFrame, facts: DataFrame, radius: int = L.NEAR) -> DataFrame:
    """claim_id, entity, first_source: names that stand somewhere but in no text within `radius` characters of the
    matched keyword (by their beginnings). Lines that list policies are left out; a name equal to the keyword or found
    nowhere is no such case.

    Texts are cut into stretches of `radius` characters: two places in one stretch are near, and for neighbouring
    stretches the last place in the first and the first in the second tell. So the work is linear in the places."""
    rows = claims.filter(~F.col("claim_text").rlike(POLICY_LINE))
    named = claim_entities(rows).select("claim_id", "entity").distinct().join(matched.select("claim_id", "keyword"), "claim_id").filter("entity <> keyword")
    known = named.join(facts.select(F.col("term").alias("entity"), "first_source"), "entity")
    pairs = known.select("entity", "keyword").distinct()

    def spots(name: str) -> DataFrame:
        """Of the terms in pairs only: least and greatest place by text and stretch."""
        mine = hits.select(F.col("term").alias(name), "source_path", "places").join(pairs.select(name).distinct(), name, "left_semi")
        at = mine.select(name, "source_path", F.explode("places").alias("at")).withColumn("stretch", F.expr(f"at div {radius}"))
        return at.groupBy(name, "source_path", "stretch").agg(F.min("at").alias(f"low_{name}"), F.max("at").alias(f"high_{name}"))

    around = spots("keyword").withColumn("_near", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)))
    around = around.select("keyword", "source_path", F.col("stretch").alias("_own"), F.col("_near").alias("stretch"), "low_keyword", "high_keyword")
    met = pairs.join(spots("entity"), "entity").join(around, ["keyword", "source_path", "stretch"])
    gap = F.when(F.col("_own") == F.col("stretch"), 0).when(F.col("_own") < F.col("stretch"), F.col("low_entity") - F.col("high_keyword")).otherwise(F.col("low_keyword") - F.col("high_entity"))
    close = met.filter(gap <= radius).select("entity", "keyword").distinct()
    return known.join(close, ["entity", "keyword"], "left_anti").select("claim_id", "entity", "first_source")


def growth_context(claims: DataFrame, placed: DataFrame, texts: DataFrame, radius: int = L.GROWTH_RADIUS) -> DataFrame:
    """claim_id, number, in_context: percentages of claims that speak of growth, and whether one of the
    claim's growth words stands around the number's first occurrence in some text."""
    words = T.found(F.col("claim_text"), T.any_of(L.GROWTH_WORDS))
    asked = claims.select("claim_id", F.array_distinct(words).alias("words"), F.explode(F.array_distinct("numbers")).alias("number")).filter("size(words) > 0 and endswith(number, '%')")
    # the first place in the text is the first in its piece, as nothing in front of it has the number
    at = F.instr("text", F.col("number"))
    start = F.greatest(at - radius, F.lit(1))
    numbers = asked.select(F.col("number").alias("term")).distinct()
    shown = placed.join(numbers, "term", "left_semi").join(texts.select("source_path", "piece_no", "text"), ["source_path", "piece_no"]).select(F.col("term").alias("number"), "text")
    shown = shown.select("number", F.substring(F.col("text"), start, at + radius - start).alias("window")).distinct()
    good = asked.join(shown, "number").filter(F.exists("words", lambda w: F.contains("window", w))).select("claim_id", "number").distinct().withColumn("hit", F.lit(True))
    return asked.select("claim_id", "number").join(good, ["claim_id", "number"], "left").select("claim_id", "number", F.coalesce("hit", F.lit(False)).alias("in_context"))


def keyword_generality(matched: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, keyword, n_found, n_sources, total_sources, short, generic."""
    total = chunks.agg(F.count_distinct("source_path").alias("total_sources"))  # one row
    # a keyword of a candidate may stand in none of the whole texts
    rows = matched.select("claim_id", "keyword").join(facts.select(F.col("term").alias("keyword"), "n_found", "n_sources"), "keyword", "left").fillna(0, ["n_found", "n_sources"]).join(F.broadcast(total))
    generic = (F.col("n_found") > L.GENERIC_OVER) & (F.col("n_sources") / F.col("total_sources") < L.DOMAIN_SHARE)
    return rows.select("claim_id", "keyword", "n_found", "n_sources", "total_sources", (F.length("keyword") <= L.SHORT_KEYWORD).alias("short"), generic.alias("generic"))


def cascade(facts: DataFrame) -> DataFrame:
    """One row of facts a claim -> status and warning codes. The columns: found, n_clauses, n_supported,
    n_entities, coverage, n_misattributed, n_numbers, n_missing, n_growth_misses, short, generic, quoted_found."""
    c = F.col
    partial = (c("n_clauses") > 1) & (c("n_supported") < c("n_clauses"))
    low = (c("n_entities") >= 2) & (c("coverage") < L.LOW_COVERAGE)
    inconsistent = low | (c("n_misattributed") > 0)
    strong = ((c("n_numbers") > 0) & (c("n_missing") < c("n_numbers"))) | c("quoted_found")
    weak = (c("short") | c("generic")) & ~strong & ~partial & ~inconsistent
    numberless = c("short") & (c("n_numbers") > 0) & (c("n_missing") == c("n_numbers"))
    refuted = (partial | inconsistent | weak) & numberless
    status = (
        F.when(~c("found"), L.NOT_FOUND).when(refuted, L.NOT_FOUND).when(partial, L.PARTIAL)
        .when(inconsistent, L.INCONSISTENT).when(weak, L.REVIEW).otherwise(L.CONFIRMED)
    )
    codes = (
        ("SUBCLAIM_UNSOURCED", partial), ("ENTITY_UNCOVERED", (c("n_entities") > 0) & (c("coverage") < 100)), ("ENTITY_MISATTRIBUTED", c("n_misattributed") > 0),
        ("NUMBER_MISSING", c("n_missing") > 0), ("GROWTH_CONTEXT", c("n_growth_misses") > 0), ("KEYWORD_SHORT", c("short")), ("KEYWORD_GENERIC", c("generic")),
        ("WEAK_MATCH_DOWNGRADED", weak), ("NO_EVIDENCE", refuted),
    )
    warned = F.filter(F.array(*(F.when(c("found") & test, code) for code, test in codes)), lambda x: x.isNotNull())
    return facts.withColumns({"status": status, "codes": warned})


def warnings(judged: DataFrame) -> Column:
    """array<struct<code, detail>> for rows of cascade(claim_facts(...)): what each warning is about."""
    c = F.col
    listed = lambda name: F.concat_ws("、", name)
    reason = F.concat_ws("/", F.when(c("short"), "过短"), F.when(c("generic"), "高频通用"))
    detail = {
        "SUBCLAIM_UNSOURCED": F.format_string("%d 个子命题中 %d 个有出处；无出处：%s", c("n_clauses"), c("n_supported"), F.concat_ws("；", "unsourced")),
        "ENTITY_UNCOVERED": F.format_string("覆盖率 %.0f%%；未找到：%s", c("coverage"), listed("uncovered")),
        "ENTITY_MISATTRIBUTED": F.format_string("“%s”附近没有：%s", c("keyword"), F.concat_ws("、", F.transform("misplaced", lambda m: F.concat(m["entity"], F.lit("（见于"), F.left(m["first_source"], F.lit(60)), F.lit("）"))))),
        "NUMBER_MISSING": F.concat(F.lit("未找到："), listed("missing")),
        "GROWTH_CONTEXT": F.concat(F.lit("不在增长语境中："), listed("growth_misses")),
        "KEYWORD_SHORT": F.format_string("“%s”只有 %d 个字", c("keyword"), F.length("keyword")),
        "KEYWORD_GENERIC": F.format_string("“%s”出现 %d 次，见于 %d/%d 份文档", c("keyword"), c("n_found"), c("n_sources"), c("total_sources")),
        "WEAK_MATCH_DOWNGRADED": F.format_string("仅靠%s的关键词“%s”，无数字或引号专名佐证", reason, c("keyword")),
        "NO_EVIDENCE": F.format_string("“%s”虽出现，但数字均未找到", c("keyword")),
    }
    known = F.create_map(*(x for code, text in detail.items() for x in (F.lit(code), F.coalesce(text, F.lit("")))))
    return F.transform("codes", lambda code: F.struct(code.alias("code"), F.element_at(known, code).alias("detail")))


def claim_facts(claims: DataFrame, chunks: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """The facts of every claim, and what it matched. claims: claim_id, claim_text, numbers, entities,
    sub_claims; chunks: chunk_id, source_path, source, chunk_offset, text; best: of retrieved_match."""
    terms = materialize(all_terms(claims), "asked")
    texts = whole_texts(chunks, terms)
    hits = materialize(document_hits(terms, texts), "hits")
    placed = materialize(term_places(hits), "places")
    facts = materialize(term_facts(placed), "term-facts")
    matched = materialize(matches(claims, placed, facts, chunks, texts, best), "matches")
    listed = lambda test, value: F.array_sort(F.collect_list(F.when(test, value)))  # noqa: E731  (a claim's own items)
    covered = facts.select(F.col("term").alias("entity"), F.lit(1).alias("hit"))
    named = claim_entities(claims).join(covered, "entity", "left")
    ordered = lambda c, name: F.transform(F.col(c), lambda s: s[name]).alias(c)
    parts = (
        clause_support(claims, facts).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.count_if("supported").alias("n_supported"), listed(~F.col("supported"), F.struct("clause_no", "clause")).alias("unsourced")).withColumn("unsourced", ordered("unsourced", "clause")),
        named.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_entities"), (F.count("hit") * 100 / F.count(F.lit(1))).alias("coverage"), listed(F.col("hit").isNull(), F.struct("entity_pos", "entity")).alias("uncovered")).withColumn("uncovered", ordered("uncovered", "entity")),
        misattributed(claims, matched, hits, facts).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_misattributed"), F.array_sort(F.collect_list(F.struct("entity", "first_source"))).alias("misplaced")),
        number_presence(claims, facts).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.count_if(~F.col("present")).alias("n_missing"), listed(~F.col("present"), F.struct("number_pos", "number")).alias("missing")).withColumn("missing", ordered("missing", "number")),
        growth_context(claims, placed, texts).groupBy("claim_id").agg(F.count_if(~F.col("in_context")).alias("n_growth_misses"), listed(~F.col("in_context"), F.col("number")).alias("growth_misses")),
        keyword_generality(matched, facts, chunks).drop("keyword"),
        claim_quotes(claims).join(facts.select(F.col("term").alias("phrase")), "phrase", "left_semi").select("claim_id").distinct().withColumn("quoted_found", F.lit(True)),
        matched,
    )
    rows = claims.select("claim_id", "claim_text")
    for part in parts:
        rows = rows.join(part, "claim_id", "left")
    zero = {n: 0 for n in ("n_clauses", "n_supported", "n_entities", "n_misattributed", "n_numbers", "n_missing", "n_growth_misses")}
    return rows.withColumn("found", F.col("keyword").isNotNull()).fillna(zero | {"coverage": 100.0, "short": False, "generic": False, "quoted_found": False})


def check_claims(claims: DataFrame, chunks: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """claim_id, claim_text, status, source, matched_keyword, snippet, context_brief, codes, warnings (code, detail),
    candidates, and the facts. found: the retrieval's (ranked, hits), see retrieval.search; without it no candidates."""
    claims = materialize(claims.select("claim_id", "claim_text", "numbers", "entities", "sub_claims"), "claims")
    best = None
    if found is not None:
        ranked, chunk_hits = found
        best = materialize(retrieved_match(claims, chunk_hits, ranked, chunks), "retrieved")
    judged = cascade(claim_facts(claims, chunks, best))
    judged = judged.withColumn("warnings", warnings(judged))
    entry = "array<struct<source:string,text:string,score:double>>"
    if found is None:
        judged = judged.withColumn("candidates", F.array().cast(entry))
    else:
        shown = ranked.join(chunks.select("chunk_id", F.coalesce("source", "source_path").alias("source"), "text"), "chunk_id")
        rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "text", "score"))), lambda r: F.struct(r["source"].alias("source"), r["text"].alias("text"), r["score"].alias("score")))
        judged = judged.join(shown.groupBy("claim_id").agg(rows.alias("candidates")), "claim_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(entry)))
    quoted = F.when(F.col("found"), F.concat(F.col("source"), F.lit(": ..."), F.col("snippet"), F.lit("...")))
    return judged.withColumns({"context_brief": F.left(F.col("snippet"), F.lit(L.BRIEF)), "snippet": quoted, "matched_keyword": F.col("keyword")}).drop("keyword")
