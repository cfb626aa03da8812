"""Extraction rules on literals."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import lexicon as L
from veritrail.functions import text as T
from veritrail.operators import claims as C
from veritrail.operators import ordering


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expression.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("获批项目356项，到账43亿元，占91%，2025年", ["2025年", "356项", "43亿元", "91%"]),
        ("１２项与3.5 倍", ["3.5 倍", "１２项"]),
        ("没有数字", []),
        ("", []),
        (None, None),
        ("5个5个15万个", ["15万个", "5个"]),
        ("面积20平方米和3m²", ["20平方米", "3m²"]),
    ],
)
def test_numbers(spark, text, expected):
    assert one(spark, T.numbers(F.col("t")), t=text) == expected


def test_entities(spark):
    pattern = T.category_pattern(["课程", "一"])
    assert one(spark, T.entities(F.col("t"), pattern), t="入选“人工智能计划”和《教学大纲》，\"AI lab\"由数据科学实验室建设") == ["由数据科学实验室建设", "人工智能计划", "AI lab", "教学大纲"]
    assert one(spark, T.entities(F.col("t"), pattern), t="“是的，这是句子。”") == []
    assert "(?:" in pattern and "|一|" not in pattern


@pytest.mark.parametrize(
    ("entity", "valid"),
    [
        ("金融大模型实验室", True), ("我们的团队", False), ("一是平台", False), ("第三阶段平台", False), ("第三批专业", True), ("因此项目", False), ("构建平台", False),
        ("等机构", False), ("这不是平台", False), ("很" * 20, False), ("《" + "很" * 20 + "》", True), ("", False), (" ", False), ("　", False),
    ],
)
def test_entity_noise(spark, entity, valid):
    assert one(spark, T.names_something(F.col("e")), e=entity) is valid


def test_clauses(spark):
    pattern = T.category_pattern()
    parts = one(spark, T.clauses(F.col("t"), pattern), t="学校入选国家级重点实验室，短句；论述性的文字没有锚点呢，到账经费达43亿元左右")
    assert [(p["text"], p["independent"]) for p in parts] == [("学校入选国家级重点实验室", True), ("论述性的文字没有锚点呢", False), ("到账经费达43亿元左右", True)]
    assert parts[2]["numbers"] == ["43亿元"]


def test_keywords(spark):
    keys = one(spark, T.keywords(F.col("t")), t="到账43亿元占91%共356项2025年，获批“人工智能计划”项目")
    assert keys[0] == "人工智能计划" and "356项" in keys and "43亿元" not in keys and len(keys) <= L.KEYWORDS_KEPT
    assert "43亿元" in one(spark, T.keywords(F.col("t"), whole_numbers=True), t="到账43亿元")
    assert one(spark, T.keywords(F.col("t")), t="short latin text without keys") == ["short latin text wit"]
    assert one(spark, T.keywords(F.col("t")), t="  ") == []


def test_snippet_and_positions(spark):
    assert one(spark, T.snippet(F.col("t"), F.col("k"), 3), t="一二三\n四五键六七八九", k="键") == " 四五键六七八"
    assert one(spark, T.snippet(F.col("t"), F.col("k")), t="没有", k="键") == ""
    for places, width, n in (([1, 2, 3], 2, 2), ([1, 3, 4, 9], 3, 3), ([], 2, 0)):
        assert spark.range(1).select(T.apart(F.array(*map(F.lit, places)).cast("array<int>"), F.lit(width)).alias("n")).first()["n"] == n


def test_query_terms(spark):
    terms = one(spark, T.query_terms(F.col("c"), F.col("n"), F.col("e")), c="防性侵六个一工作推进", n=["6个"], e=["六个一 ", "六个一"])
    assert terms[0] == "防性侵六个一工作推进" and terms[1:3] == ["六个一", "6个"]
    assert one(spark, T.query_terms(F.col("c"), F.col("n"), F.col("e")), c=" ", n=[], e=[]) == []


def test_split_claims(spark):
    text = "第一句话的长度超过十个字符了。短句。第一句话的长度超过十个字符了；1. 2、3）1. 2、3）\n第二句话的长度也超过十个字符"
    rows = C.split_claims(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), "doc_id").orderBy("pos").collect()
    assert [(r["pos"], r["claim_text"]) for r in rows] == [(0, "第一句话的长度超过十个字符了"), (4, "第二句话的长度也超过十个字符")]


def test_prompt_texts(spark):
    text = "\n\n".join(["甲" * 40, "乙" * 30, " ", "丙" * 200, "丁" * 10])
    parts = [r["part"] for r in C.prompt_texts(spark.createDataFrame([(1, text), (2, "")], "i int, text string"), "i", 80).orderBy("part_no").collect()]
    assert parts == ["甲" * 40 + "\n" + "乙" * 30, "丙" * 200, "丁" * 10]


def test_conflicts(spark):
    rows = [("p", 1, "某实验室获批国家重点项目", ["某实验室"]), ("p", 2, "某实验室主办学术论坛会议", ["某实验室"]), ("p", 3, "某实验室获批国家重点项目", ["某实验室"]), ("q", 4, "某实验室", ["某实验室"])]
    found = C.conflicts(spark.createDataFrame(rows, "target_path string, claim_id int, claim_text string, entities array<string>")).collect()
    assert sorted((r["claim_id"], r["n"], r["n_conflicts"]) for r in found) == [(1, 2, 1), (2, 1, 2)]


def test_conflicts_by_force(spark):
    rng = random.Random(9)
    words = ["获批项目甲", "主办论坛乙", "经费增长丙", "成果发布丁", "学科建设戊"]
    rows = [("p", k, "，".join(["某实验室", *rng.sample(words, rng.randint(0, 4))]), ["某实验室"]) for k in range(60)]
    df = spark.createDataFrame(rows, "target_path string, claim_id int, claim_text string, entities array<string>")
    near = {k: frozenset(r["w"]) for k, r in zip(range(60), df.select(T.attribute_words(F.col("claim_text"), F.lit("某实验室")).alias("w")).collect())}
    expected = {}
    for k, w in near.items():
        n = sum(1 for v in near.values() if v != w and len(w & v) / len(w | v) < 0.3)
        if n and k == min(j for j, v in near.items() if v == w):
            expected[k] = (sum(v == w for v in near.values()), n)
    assert {r["claim_id"]: (r["n"], r["n_conflicts"]) for r in C.conflicts(df).collect()} == expected and len(expected) > 5


def test_neighbours_and_batches(spark):
    df = spark.createDataFrame([("p", k, k, f"c{k}") for k in range(8)], "target_path string, claim_id int, pos int, claim_text string")
    rows = C.neighbours(df).orderBy("pos").collect()
    assert (rows[0]["before"], rows[0]["after"], rows[7]["after"]) == ("", "c1", "")
    assert [(r["batch_no"], r["index"]) for r in C.batches(df, "claim_id", 6, "target_path").orderBy("claim_id").collect()][5:7] == [(0, 6), (1, 1)]


def test_order_across_ranges(spark):
    """Numbers and neighbours don't depend on where a key's rows are cut; nulls, ties and a null key included."""
    rng = random.Random(10)
    rows = [(rng.choice(["p", "p", "p", "q", None]), k, rng.choice([None, rng.randint(0, 50)]), rng.choice([None, f"c{k}"])) for k in range(300)]
    df = spark.createDataFrame(rows, "target_path string, claim_id int, pos int, claim_text string").withColumn("n", F.lit("clash")).drop("n")
    expected = {}
    for target in ("p", "q", None):
        mine = sorted((r for r in rows if r[0] == target), key=lambda r: (-1 if r[2] is None else r[2], r[1]))
        for i, r in enumerate(mine):
            expected[r[1]] = (i + 1, mine[i - 1][3] or "" if i else "", mine[i + 1][3] or "" if i + 1 < len(mine) else "")
    for width in (7, 10_000):
        got = ordering.numbered(df, ["target_path"], ["pos", "claim_id"], width=width).select("claim_id", "n").collect()
        assert {r["claim_id"]: r["n"] for r in got} == {k: v[0] for k, v in expected.items()}
        near = ordering.neighbours(df, "target_path", ["pos", "claim_id"], "claim_text", width).collect()
        assert {r["claim_id"]: (r["before"], r["after"]) for r in near} == {k: v[1:] for k, v in expected.items()}
