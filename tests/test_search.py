"""Containment, retrieval, chunking and the verification rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import lexicon as L
from veritrail.functions import text as T
from veritrail.operators import chunking, retrieval, verify
from veritrail.operators.containment import HEAD, contains_join, levelled
from veritrail.operators.documents import pieces
from veritrail.operators.membership import membership


def test_contains_join(spark):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice("甲乙丙aA.%😀") for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(900, None), (901, "")]
    terms = {"".join(rng.choice("甲乙丙aA.%😀") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5)} | {"%", "aa"}
    t = spark.createDataFrame([(x,) for x in terms] + [(None,), ("",), ("aa",)], "term string").withColumn("gram", F.lit(0))
    d = spark.createDataFrame(texts, "chunk_id bigint, text string").withColumn("levelled", F.lit("clash"))
    got = {(r["term"], r["chunk_id"]): (r["n_found"], r["places"]) for r in contains_join(t, d, "chunk_id").collect()}
    places = lambda x, y: [i + 1 for i in range(len(y)) if y.startswith(x, i)]
    assert got == {(x, k): (y.count(x), places(x, y)) for x in terms for k, y in texts if y and x in y}
    got = {(r["term"], r["chunk_id"]): (r["n_found"], r["n_exact"]) for r in contains_join(t, d, "chunk_id", ignore_case=True).collect()}
    assert got == {(x, k): (y.lower().count(x.lower()), y.count(x)) for x in terms for k, y in texts if y and x.lower() in y.lower()}
    assert contains_join(t.limit(0), d, "chunk_id").count() == 0 and contains_join(t, d.limit(0), "chunk_id").count() == 0


def test_long_terms(spark):
    rng = random.Random(3)
    body = "".join(rng.choice("甲乙丙丁戊") for _ in range(5000))
    terms = [body[a : a + n] for a, n in ((0, HEAD), (10, HEAD + 1), (300, 400), (4000, 1000))] + [body[:HEAD] + "己", "A" + body[:100]]
    texts = [(1, "x", body), (2, "y", None), (3, "z", "a" + body)]
    d = spark.createDataFrame(texts, "k bigint, name string, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    expected = lambda f: {(x, k): [i + 1 for i in range(len(y)) if f(y).startswith(f(x), i)] for x in terms for k, _, y in texts if y and f(x) in f(y)}
    assert {(r["term"], r["k"]): r["places"] for r in contains_join(t, d, "k", "name").collect()} == expected(str)
    assert {(r["term"], r["k"]): r["places"] for r in contains_join(t, d, "k", "name", ignore_case=True).collect()} == expected(levelled)
    assert levelled("İA") == "İa"
    assert contains_join(t, d.unionByName(d), "k", "name").count() == 2 * len(expected(str))  # a text delivered twice is found twice


def test_membership_loses_nothing(spark):
    keys = [k * 7919 - 3 for k in range(5000)]
    known = membership(spark.createDataFrame([(k,) for k in keys], "key bigint"), "key", len(keys)).value
    import numpy as np

    assert known(np.array(keys, np.int64)).size == len(keys)
    assert known(np.arange(10**7, 10**7 + 100000, dtype=np.int64)).size < 200
    assert membership(spark.createDataFrame([], "key bigint"), "key", 0).value(np.arange(9, dtype=np.int64)).size == 0


def test_pieces_by_force(spark):
    rng = random.Random(4)
    rows, wholes = [], {}
    for source in "abc":
        parts, at = [], rng.randint(0, 30)
        for _ in range(40):
            parts.append((at, "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(0, 60)))))
            at = max(0, at + rng.randint(-5, 60))
        text = ""
        for offset, part in sorted(parts, key=lambda p: (p[0], -len(p[1]), p[1])):
            if offset + len(part) > len(text):
                text = text + "\n" * (offset - len(text)) + part[max(0, len(text) - offset) :]
        wholes[source] = text
        rows += [(source, o, p) for o, p in parts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [("n", 0, None), ("e", 5, ""), ("z", None, "甲")], "source_path string, chunk_offset int, text string").withColumn("own", F.lit(0))
    got = {}
    for r in pieces(df, 16, 7, 11, 64).collect():
        start = r["piece_no"] * 16
        text = wholes.get(r["source_path"], "甲")
        # the newlines of a gap that a stretch ends in are left out
        assert r["text"].rstrip("\n") == text[start - r["lead"] : start + 16 + 11].rstrip("\n") and r["lead"] == (0 if start == 0 else 7), (r, text)
        got.setdefault(r["source_path"], {}).update(enumerate(r["text"][r["lead"] : r["lead"] + r["own"]], start))
    assert {k: "".join(v.get(n, "\n") for n in range(max(v) + 1)) for k, v in got.items()} == wholes | {"z": "甲"}
    assert pieces(df.limit(0)).count() == 0


def windows_by_force(text, target, overlap, crawl):
    import re

    points = [(len(text), 0)]
    for rank, p in enumerate((r"\n\n+", r"[。！？…]+[\n\r]*", r"[.!?][ \t\n\r]+")):
        points += [(m.end(), rank) for m in re.finditer(p, text)]
    out, start = [], 0
    while start < len(text):
        inside = [p for p in points if start < p[0] <= start + target]
        if inside:
            best = min(r for _, r in inside)
            end = max(e for e, r in inside if r == best)
        else:
            end = min(e for e, _ in points if e > start)
        if text[start:end].strip():
            out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = max(start + 1, end - overlap) if crawl or end - overlap > start else end
    return out


@pytest.mark.parametrize("crawl", [True, False])
def test_windows(spark, crawl):
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("甲乙丙丁戊。\n. !") for _ in range(rng.randint(0, 200)))
        assert chunking.windows(text, 40, 10, crawl) == windows_by_force(text, 40, 10, crawl)
    assert len(chunking.windows("A" * 100 + "\n\n" + "B" * 1000, crawl=True)) == 101
    rows = chunking.chunk_texts(spark.createDataFrame([(1, "甲。" * 400), (2, None), (3, " ")], "doc_id bigint, text string"), "doc_id").collect()
    assert {r["doc_id"] for r in rows} == {1} and all(r["text"] == ("甲。" * 400)[r["offset"] : r["offset"] + len(r["text"])] for r in rows)


def corpus(spark, *texts):
    rows = [(k, f"d{k % 7}", f"d{k % 7}", 100000 * (k // 7), t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id bigint, source_path string, source string, chunk_offset int, text string")


def claim(spark, text, numbers=(), entities=()):
    df = spark.createDataFrame([(1, text, list(numbers), list(entities))], "claim_id bigint, claim_text string, numbers array<string>, entities array<string>")
    return df.withColumn("sub_claims", T.clauses(F.col("claim_text"), T.category_pattern()))


def test_retrieval_by_force(spark):
    texts = ["获批国家项目356项，经费充足", "国家项目的说明，与经费无关的内容比较长一些", "完全无关的内容", "经费43亿元，获批国家项目", "防性侵工作六个一", "六个一工程"] * 3
    chunks = corpus(spark, *texts)
    asked = claim(spark, "获批国家项目356项", ["356项"], ["国家项目"])
    terms = [r["term"] for r in retrieval.search_terms(asked).orderBy("term_pos").collect()]
    sizes = [max(len(t) - 2, 0) for t in texts]
    score, first = {}, {}
    for pos, term in enumerate(terms):
        hits = [(k, t.count(term)) for k, t in enumerate(texts) if term in t]
        if not hits:
            continue
        idf = max(math.log((len(texts) - len(hits) + 0.5) / (len(hits) + 0.5)), 0) or 1e-6
        ranked = sorted(hits, key=lambda h: (-round(idf * h[1] * 2.2 / (h[1] + 1.2 * (0.25 + 0.75 * sizes[h[0]] * len(texts) / sum(sizes))), 9), h[0])) if len(term) >= 3 else sorted(hits, key=lambda h: (-h[1], h[0]))
        for rank, (k, _) in enumerate(ranked[:60], 1):
            score[k] = score.get(k, 0) + (2 if pos == 0 else 1) / (60 + rank)
            first.setdefault(k, (pos, rank))
    score = {k: v if any(t in texts[k] for t in ("356项", "国家项目")) else v * 0.4 for k, v in score.items()}
    expected = sorted(score, key=lambda k: (-round(score[k], 12), first[k], k))[:5]
    got = retrieval.candidates(asked, chunks).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == expected and [r["score"] for r in got] == [round(score[k], 6) for k in expected]
    assert retrieval.candidates(claim(spark, " "), chunks).count() == 0


CASES = {
    # name: (claim, numbers, entities, texts, status, codes that must be there)
    "long keyword and number": ("人工智能实验室获批项目356项左右", ["356项"], [], ["人工智能实验室获批项目356项左右的说明"], L.CONFIRMED, ()),
    "nothing found": ("完全不存在的表述内容在此处", [], [], ["别的文字"], L.NOT_FOUND, ()),
    "short keyword, numbers absent": ("「人工智」共计999项abc的内容", ["999项"], [], ["人工智出现在这里"], L.NOT_FOUND, ("KEYWORD_SHORT", "NO_EVIDENCE")),
    "short keyword, a number present": ("「人工智」共计9项abc的内容", ["9项"], [], ["人工智出现，另有9项"], L.CONFIRMED, ("KEYWORD_SHORT",)),
    "long keyword, numbers absent": ("人工智能重点实验室达999项", ["999项"], [], ["人工智能重点实验室达到了"], L.CONFIRMED, ("NUMBER_MISSING",)),
    "far from the keyword": ("金融大模型实验室入选国家重大项目名单", [], ["金融大模型实验室"], ["金融大模型实验室" + "甲" * 400 + "入选国家重大项目名单"], L.INCONSISTENT, ("ENTITY_MISATTRIBUTED",)),
    "policy line": ("政策依据：金融大模型实验室入选国家重大项目名单", [], ["金融大模型实验室"], ["金融大模型实验室" + "甲" * 400 + "入选国家重大项目名单"], L.CONFIRMED, ()),
    "half of the names": ("人工智能重点实验室达到国内领先水平", [], ["不存在平台", "无此中心", "人工智能重点实验室"], ["人工智能重点实验室达到国内领先水平"], L.INCONSISTENT, ("ENTITY_UNCOVERED",)),
    "noise names": ("人工智能重点实验室达到国内领先水平", [], ["我们的平台", "构建平台"], ["人工智能重点实验室达到国内领先水平"], L.CONFIRMED, ()),
    "growth elsewhere": ("人工智能重点实验室经费增长12%左右", ["12%"], [], ["人工智能重点实验室经费增长，" + "乙" * 60 + "占比12%"], L.CONFIRMED, ("GROWTH_CONTEXT",)),
    "partial": ("学校入选国家级重点实验室，另有获批不存在的东西九九", [], [], ["学校入选国家级重点实验室"], L.PARTIAL, ("SUBCLAIM_UNSOURCED",)),
    "generic keyword": ("获批人工智能相关的内容", [], [], ["获批人工智能相关的内容" * 21] + ["别的"] * 6, L.REVIEW, ("KEYWORD_GENERIC", "WEAK_MATCH_DOWNGRADED")),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    text, numbers, entities, texts, status, codes = CASES[name]
    row = verify.check_claims(claim(spark, text, numbers, entities), corpus(spark, *texts)).first()
    assert row["status"] == status, row
    assert set(codes) <= set(row["codes"]) and (codes or not row["codes"]), row


def test_retrieved_match_goes_first(spark):
    chunks = corpus(spark, "人工智能项目", "人工智能项目与经费356项，获批人工智能项目")
    asked = claim(spark, "获批人工智能项目356项", ["356项"])
    found = retrieval.search(asked, chunks, verify.claim_keywords(asked).select(F.col("keyword").alias("term")))
    row = verify.check_claims(asked, chunks, found).first()
    assert row["source"] == "d1" and row["status"] == L.CONFIRMED
    assert [c["source"] for c in row["candidates"]] == ["d1", "d0"] and row["candidates"][0]["text"] == "人工智能项目与经费356项，获批人工智能项目"


def one_source(spark, *parts):
    """A source in chunks (offset, text)."""
    return spark.createDataFrame([(k, "d", None, at, t) for k, (at, t) in enumerate(parts)], "chunk_id bigint, source_path string, source string, chunk_offset int, text string")


def test_evidence_across_the_edge_of_a_chunk(spark):
    asked = claim(spark, "金融大模型实验室入选国家重大项目名单", entities=["金融大模型实验室"])
    front, behind = "甲" * 900 + "金融大模型实验室" + "乙" * 100, "丙" * 80 + "入选国家重大项目名单" + "丁" * 30
    row = verify.check_claims(asked, one_source(spark, (0, front), (len(front), behind))).first()
    assert row["status"] == L.CONFIRMED and row["source"] == "d", row
    # the keyword itself lies across the edge
    text = front + behind
    at = text.index("入选国家重大项目名单") + 5
    row = verify.check_claims(asked, one_source(spark, (0, text[:at]), (at, text[at:]))).first()
    assert row["status"] == L.CONFIRMED and "入选国家重大项目名单" in row["snippet"]
    far = verify.check_claims(asked, one_source(spark, (0, front), (len(front) + 300, behind))).first()
    assert far["status"] == L.INCONSISTENT and [w["code"] for w in far["warnings"]] == far["codes"] == ["ENTITY_MISATTRIBUTED"]
    assert "金融大模型实验室（见于d）" in far["warnings"][0]["detail"]


def test_overlaps_count_once(spark):
    """Twelve occurrences in two chunks that overlap by ten of them are twelve, not twenty-two."""
    key = "获批人工智能相关的内容"
    text = key * 12
    cut = 2 * len(key)
    texts = one_source(spark, (0, text), (cut, text[cut:])).unionByName(spark.createDataFrame([(9 + k, f"e{k}", None, 0, "别的") for k in range(6)], "chunk_id bigint, source_path string, source string, chunk_offset int, text string"))
    row = verify.check_claims(claim(spark, key), texts).first()
    assert row["n_found"] == 12 and not row["generic"] and row["status"] == L.CONFIRMED


def test_distance_by_force(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["子丑寅", "卯辰巳", "午" * rng.randint(1, 250)]) for _ in range(60))
    texts = one_source(spark, *((a, text[a : a + 400]) for a in range(0, len(text), 300)))
    asked = spark.createDataFrame([(1, "x", ["卯辰巳"])], "claim_id bigint, claim_text string, entities array<string>")
    terms = spark.createDataFrame([("子丑寅",), ("卯辰巳",)], "term string")
    hits = verify.document_hits(terms, verify.whole_texts(texts, terms))
    facts = verify.term_facts(verify.term_places(hits))
    matched = spark.createDataFrame([(1, "子丑寅")], "claim_id bigint, keyword string")
    places = lambda x: [i for i in range(len(text)) if text.startswith(x, i)]
    least = min(abs(a - b) for a in places("子丑寅") for b in places("卯辰巳"))
    for radius in (least - 1, least, least + 1, 40):
        if radius > 0:
            assert (verify.misattributed(asked, matched, hits, facts, radius).count() == 0) == (radius >= least)
