"""The penalty is applied to the chunks of short terms too."""

from veritrail.plans import search

from .test_search import claim, corpus


def test_short_terms_count(spark, monkeypatch):
    monkeypatch.setattr(search, "asked", lambda *_: claim(spark, "项目356项，经费", ["6项"], ["人才"]))
    monkeypatch.setattr(search, "corpus", lambda *_: corpus(spark, "人才很多", "经费很多", "有6项", "项目356项，经费", "完全无关"))
    got = {r["penalised"]: (r["n_chunks"], r["best"]) for r in search.anchor_penalty(spark, "").collect()}
    # terms: the claim, 人才, 6项, 经费, 项目; chunks 0, 2 and 3 have a name or number, chunk 1 has none
    best = 2 / 61 + 1 / 62 + 1 / 62 + 1 / 61
    assert got == {False: (3, round(best, 6)), True: (1, round(0.4 / 61, 6))}
