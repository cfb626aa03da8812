"""Slips in organisation names, decided without a large table."""

import pytest

from veritrail.llm import name_variants as N

# the pairs of scale 0.01 that were refused, how often each stands, and names of the same table that share their characters
PAIRS = [("杨青桑橘纺织学院", 16, "扬青桑橘纺织学院", 4), ("沂兰棠桃海洋中心", 5, "易兰棠桃海洋中心", 1), ("楠岚岭麓林草学院", 27, "南岚岭麓林草学院", 1), ("禾竹荻枫财经研究院", 6, "禾竹迪枫财经研究院", 3)]
OTHERS = ["椿荷杨琼粮食大学", "屿楠梧柏矿业中心", "荻榆麓湖理工大学"]


def entities(spark, rows):
    return {r["name"]: r["entity"] for r in N.linked_names(spark.createDataFrame(rows, "name string, n bigint")).collect()}


@pytest.mark.parametrize("others", [OTHERS, []])
def test_slips_in_a_small_table(spark, others):
    rows = [(n, c) for a, x, b, y in PAIRS for n, c in ((a, x), (b, y))] + [(n, 5) for n in others]
    got = entities(spark, rows)
    for a, _, b, _ in PAIRS:
        assert got[a] == got[b], (a, b)
    assert len(set(got.values())) == len(PAIRS) + len(others)


def test_a_slip_that_stands_once_more(spark):
    """Here the other slip's right spelling isn't stored."""
    got = entities(spark, [("楠岚岭麓林草学院", 27), ("南岚岭麓林草学院", 1), ("南岭峰榆电子联盟", 2), ("楠柿枣谷海洋大学", 3), ("棠楠柳岭政法大学", 3)])
    assert got["楠岚岭麓林草学院"] == got["南岚岭麓林草学院"] and len(set(got.values())) == 4


def test_usual_characters_are_no_slips(spark):
    """Two places of unequal frequency, each character also used in names without a counterpart; and a whole grid of places."""
    apart = [("杨青桑橘纺织学院", 16), ("桐青桑橘纺织学院", 4), ("杨琼枣谷海洋大学", 3), ("桐云柳岭政法大学", 3)]
    grid = [(f"{p}{q}师范大学", n) for p, n in (("兰渡", 9), ("榴渡", 2)) for q in ("枣谷", "柳岭", "棠桃")]
    got = entities(spark, apart + grid)
    assert len(set(got.values())) == len(apart) + len(grid)
