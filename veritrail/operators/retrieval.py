"""Evidence retrieval: phrase BM25, plain counts, reciprocal rank fusion and the anchor penalty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..session import materialize
from .containment import contains_join

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def phrase_hits(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """term, chunk_id, n_found, n_exact, size: chunks (chunk_id, text) that hold a term in either case, with
    its occurrences regardless of case and as written, and the chunk's number of trigrams."""
    hits = contains_join(terms, chunks, "chunk_id", ignore_case=True)
    return hits.select("term", "chunk_id", "n_found", "n_exact", F.greatest(F.col("n_chars") - 2, F.lit(0)).alias("size"))


def bm25(hits: DataFrame, chunks: DataFrame, limit: int = L.TERM_LIMIT) -> DataFrame:
    """term, chunk_id, rank, score of the best `limit` chunks a term; equal scores by chunk_id."""
    corpus = chunks.filter("text is not null").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("mean_size"))  # one row
    with_term = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_with"))
    idf = F.log((F.col("n_chunks") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    tf = F.col("n_found")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    scored = hits.join(with_term, "term").join(F.broadcast(corpus)).select("term", "chunk_id", score.alias("score"))
    return top(scored, limit)


def counted(hits: DataFrame, limit: int = L.TERM_LIMIT) -> DataFrame:
    """The same with the number of exact occurrences for the score, as for terms too short for trigrams."""
    return top(hits.select("term", "chunk_id", F.col("n_exact").cast("double").alias("score")), limit)


def top(scored: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def search_terms(claims: DataFrame) -> DataFrame:
    """claim_id, claim_text, numbers, entities -> claim_id, term, term_pos (from 0)."""
    terms = T.query_terms(F.col("claim_text"), F.col("numbers"), F.col("entities"))
    return claims.select("claim_id", F.posexplode(terms).alias("term_pos", "term"))


def fuse(terms: DataFrame, ranked: DataFrame) -> DataFrame:
    """claim_id, chunk_id, score, first: reciprocal ranks summed over a claim's terms, the first term doubly."""
    weight = F.when(F.col("term_pos") == 0, L.CLAIM_WEIGHT).otherwise(1.0)
    met = terms.join(ranked.select("term", "chunk_id", "rank"), "term")
    return met.groupBy("claim_id", "chunk_id").agg(F.sum(weight / (L.RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("term_pos", "rank")).alias("first"))


def penalised(fused: DataFrame, claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Scores times 0.4 for chunks with none of the claim's numbers and names; unchanged without any. The numbers and
    names are search terms, so hits (term, chunk_id, n_exact) tell where they stand as written."""
    exact = materialize(claims.select("claim_id", T.exact_terms(F.col("numbers"), F.col("entities")).alias("exact")), "exact-terms")
    held = exact.select("claim_id", F.explode("exact").alias("term")).join(hits.filter("n_exact > 0").select("term", "chunk_id"), "term").select("claim_id", "chunk_id").distinct().withColumn("_held", F.lit(True))
    rows = fused.join(exact.select("claim_id", (F.size("exact") > 0).alias("_asks")), "claim_id").join(held, ["claim_id", "chunk_id"], "left")
    off = F.col("_asks") & F.col("_held").isNull()
    return rows.select("claim_id", "chunk_id", F.when(off, F.col("score") * L.PENALTY).otherwise(F.col("score")).alias("score"), "first", off.alias("penalised"))


def scores(claims: DataFrame, chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """claim_id, chunk_id, score, first, penalised: every chunk that a term of the claim ranks. hits: the
    phrase_hits of the search terms and maybe of others, where they are there already."""
    terms = materialize(search_terms(claims), "search-terms")
    hits = materialize(phrase_hits(terms, chunks), "phrase-hits") if hits is None else hits.join(terms.select("term").distinct(), "term", "left_semi")
    long = F.length(F.replace("term", F.lit(" "), F.lit(""))) >= 3
    ranked = bm25(hits.filter(long), chunks).unionByName(counted(hits.filter(~long)))
    return penalised(fuse(terms, ranked), claims, hits)


def ranked(scored: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy(F.desc(F.round("score", 12)), "first", "chunk_id"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    return best.select("claim_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def candidates(claims: DataFrame, chunks: DataFrame, top_k: int = L.TOP_K) -> DataFrame:
    """claims (claim_id, claim_text, numbers, entities), chunks (chunk_id, text) -> claim_id, chunk_id, rank,
    score: the best chunks a claim. Terms of three characters or more (spaces not counted) rank by BM25,
    shorter ones by count. Equal scores go by the term, then the rank, that found the chunk first."""
    return ranked(scores(claims, chunks), top_k)


def search(claims: DataFrame, chunks: DataFrame, keywords: DataFrame, top_k: int = L.TOP_K) -> tuple[DataFrame, DataFrame]:
    """The candidates, and the hits of search terms and keywords (term) in the chunks: one scan serves both."""
    terms = search_terms(claims).select("term").unionByName(keywords.select("term"))
    hits = materialize(phrase_hits(terms, chunks), "phrase-hits")
    return materialize(ranked(scores(claims, chunks, hits), top_k), "candidates"), hits
