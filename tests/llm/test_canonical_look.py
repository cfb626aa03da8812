"""Canonical equivalents get one form, whatever else stands in the text."""

import unicodedata

import duckdb

from veritrail.llm.same_look import look_map, look_sql

SAME = [("ｶﾞ", "ガ"), ("ガ", "ガ"), ("ﾄﾞ", "ド"), ("ﾊﾟ", "パ"), ("ベ", "ベ"), ("ά", "ά"), ("ά", "á"), ("ѐ", "ѐ"), ("\U0002f81a", "冬"), (";", ";"), ("·", "·"), ("〈", "〈"), ("क़", "क़")]
OTHER = [("ガ", "カ"), ("ド", "ト"), ("ά", "α"), ("ベ", "ヘ"), ("パ", "バ")]


def looks(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (item VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", [(str(k), t) for k, t in enumerate(texts)])
    got = dict(con.execute(look_sql()).fetchall())
    return [got[str(k)] for k in range(len(texts))]


def test_canonical_equivalents():
    for a, b in SAME:
        x, y, x2, y2 = looks([a, b, a + "甲é", b + "甲é"])
        assert x == y and x2 == y2 == x + "甲é", (a, b, x, y, x2, y2)
    for a, b in OTHER:
        x, y = looks([a, b])
        assert x != y, (a, b)


def test_every_character_and_its_canonical_forms():
    # to U+2FFFF, where the last compatibility ideographs stand; surrogates aren't text
    chars = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFD", chr(c)) != chr(c)]
    con = duckdb.connect()
    rows = [(f"{k} {c}", unicodedata.normalize(form, c) if form else c) for k, c in enumerate(chars) for form in (None, "NFC", "NFD")]
    import pyarrow as pa

    con.register("texts", pa.table({"item": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    forms = {}
    for item, look in con.execute(look_sql()).fetchall():
        forms.setdefault(item, set()).add(look)
    assert [i for i, f in forms.items() if len(f) > 1] == []
    again = pa.table({"item": list(forms), "text": [min(f) for f in forms.values()]})
    con.register("texts", again)
    assert all({look} == forms[item] for item, look in con.execute(look_sql()).fetchall())
    assert all(b not in look_map() for b in look_map().values())


def test_kana_in_words_stay():
    """A kana that looks like an ideograph is one only where it stands alone among other characters."""
    words = ["エンジン", "カタログ", "東京タワー", "ロボット", "ニュース", "データ"]
    assert looks(words) == words
    for a, b in (("理エ科", "理工科"), ("人ロ", "人口"), ("カ学", "力学"), ("エ、カ。", "工、力。"), ("中エ大カ小", "中工大力小"), ("人ﾛ", "人口")):
        x, y = looks([a, b])
        assert x == y == b, (a, x, y)


def test_letters_that_look_alike():
    for a, b in (("𝐀𝑏𝖈", "Abc"), ("ɡo", "go"), ("ıӏ", "il"), ("օ", "o"), ("ᎪᏴ", "AB"), ("ꓐꓳꓫ", "BOX"), ("МОСКВА"[:2], "MO")):
        x, y = looks([a, b])
        assert x == y, (a, b, x, y)
    for a, b in (("𝟏", "1"), ("к", "k"), ("m²", "m2")):
        x, y = looks([a, b])
        assert x != y, (a, b)
