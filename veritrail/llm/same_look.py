"""Problem 5: one form for texts that look the same, by DuckDB SQL inside Arrow partitions.

Steps of the SQL, in this order: invisible characters and variation selectors go; half-width kana become
wide; combining marks are composed (nfc_normalize, which also maps CJK compatibility ideographs), so that
canonical equivalents are one before anything is translated; characters are translated to the one that
they look like; a kana that looks like an ideograph becomes one where no other kana stands beside it, so that
Japanese words stay; what the translation left to compose is composed. Every text is composed, so that a
character's form doesn't depend on the rest of the text. Translation covers width forms, kinds of space, radicals, letters of
the mathematical alphabets, and look-alike letters and ideographs. What looks different stays different: raised figures,
missing accents, letter case, other digits and words.

The tables follow from the Unicode database where it has the mapping; only look-alikes that it doesn't
map are listed. Long tables are applied only to rows that a regular expression finds to need them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Pairs of a character and the character that it looks like.
LOOKALIKES = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi νv οo ρp υu ϳj "  # Greek
    "АA ВB ЕE ЗЗ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj ЅS ІI ЈJ ԁd ԛq ԝw һh "  # Cyrillic
    "ЇÏ їï Ёë ёë ӧö ӓä ӒÄ ӦÖ Ӧö "
    "ɡg ɑa ıi ȷj օo սu ӏl Ӏl ǀl ꓲI ꓳO ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓴU "  # Latin, Armenian, palochka, Lisu
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ "  # Cherokee
    "ヘへ 〇○ "  # kana and marks
    "內内 靑青 敎教 淸清 眞真 戶户 呂吕 別别 吿告 說説 爲為 卽即 黃黄 產産 絕絶 值値 强強 吳呉 册冊 没沒 "  # ideographs
    "⺁厂 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 "
    "⺫罒 ⺬示 ⺭礻 ⺮竹 ⺯糸 ⺰纟 ⺱罓 ⺲罒 ⺴罓 ⺶羊 ⺷羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 "
    "⻕阜 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟食 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟 "  # radicals without a mapping of their own
    "・· ‧· ∙· •· ‐- ‑- ⁃- ˗- ∶: ꞉: ։: ∕/ ⁄/ ⟨〈 ⟩〉 〈〈 〉〉 "  # marks
)
# Kana that look like ideographs.
KANA = {"エ": "工", "カ": "力", "ニ": "二", "ハ": "八", "ロ": "口", "タ": "夕", "ト": "卜", "オ": "才"}
# Ranges of characters that have no look of their own.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE01EF))
# Spaces other than U+0020; the blocks whose compatibility mappings keep the look.
SPACES = (0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
SAME_LOOK_BLOCKS = ((0xFF01, 0xFFEE), (0x2E80, 0x2FDF), (0x2160, 0x217F), (0xFE10, 0xFE6F))


@cache
def look_map() -> dict[str, str]:
    """Character -> the character that it looks like; chains are resolved."""
    first: dict[str, str] = {chr(c): " " for c in SPACES}
    for low, high in SAME_LOOK_BLOCKS:
        for code in range(low, high + 1):
            out = unicodedata.normalize("NFKC", chr(code))
            if len(out) == 1 and out != chr(code):
                first[chr(code)] = out
    for code in range(0x1D400, 0x1D7CC):  # mathematical alphabets, less their digits
        out = unicodedata.normalize("NFKC", chr(code))
        if len(out) == 1 and out != chr(code):
            first[chr(code)] = out
    first |= {a: b for a, b in LOOKALIKES.split() if a != b}
    resolved = {}
    for c, out in first.items():
        seen = {c}
        while out in first and out not in seen:
            seen.add(out)
            out = first[out]
        resolved[c] = unicodedata.normalize("NFC", out)
    composed = [(chr(c), chr(int(d[0], 16)), chr(int(d[1], 16))) for c in range(0x110000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and not d[0].startswith("<")]
    more = True
    while more:  # a letter with its mark looks like the other letter with that mark
        more = {c: out for c, base, mark in composed if c not in resolved and base in resolved and len(out := unicodedata.normalize("NFC", resolved[base] + mark)) == 1 and out != c}
        resolved |= more
    return {c: out for c, out in resolved.items() if c != out}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(codes: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in codes) + "]"


def _ranges(chars: list[str]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


@cache
def look_sql(column: str = "text", source: str = "texts", keep: str = "item") -> str:
    """The SQL of the steps, over a table with the columns `keep` and `column`."""
    mapping = look_map()
    often = [c for c in mapping if 0xFF01 <= ord(c) <= 0xFF1F or c in "　 \t"]  # punctuation and digits: short, for nearly all rows
    rest = [c for c in mapping if c not in set(often)]
    table = lambda chars: f"{_quoted(''.join(chars))}, {_quoted(''.join(mapping[c] for c in chars))}"
    ligatures = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
    visible = f"CASE WHEN regexp_matches({column}, '{_class(list(INVISIBLE))}') THEN regexp_replace({column}, '{_class(list(INVISIBLE))}', '', 'g') ELSE {column} END"
    spelled = "s1"
    for c, out in ligatures.items():
        spelled = f"replace({spelled}, {_quoted(c)}, {_quoted(out)})"
    kana = "".join(map(chr, range(0xFF66, 0xFFA0)))
    wide = f"CASE WHEN regexp_matches(v, '[\\x{{FF66}}-\\x{{FF9F}}]') THEN translate(v, {_quoted(kana)}, {_quoted(unicodedata.normalize('NFKD', kana))}) ELSE v END"
    other, alone = "[^\\x{3041}-\\x{30FF}]", "s2"
    for c, out in KANA.items():  # twice, for neighbours share the character between them
        for _ in range(2):
            alone = f"regexp_replace({alone}, '(^|{other}){c}($|{other})', '\\1{out}\\2', 'g')"
    return f"""
      WITH v AS (SELECT {keep}, {visible} AS v FROM {source}),
      s0 AS (SELECT {keep}, nfc_normalize({wide}) AS s0 FROM v),
      s1 AS (SELECT {keep}, CASE WHEN regexp_matches(s0, '{_class(_ranges(rest))}') THEN translate(s0, {table(rest)}) ELSE s0 END AS s1 FROM s0),
      s2 AS (SELECT {keep}, translate(CASE WHEN regexp_matches(s1, '[\\x{{FB00}}-\\x{{FB06}}]') THEN {spelled} ELSE s1 END, {table(often)}) AS s2 FROM s1),
      s3 AS (SELECT {keep}, CASE WHEN regexp_matches(s2, '[{''.join(KANA)}]') THEN {alone} ELSE s2 END AS s3 FROM s2)
      SELECT {keep}, nfc_normalize(s3) AS look FROM s3"""


def _same_look() -> object:
    schema = pa.schema([("item", pa.string()), ("look", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for batch in batches:
            con.register("texts", pa.Table.from_batches([batch]))
            yield from con.sql(look_sql()).to_arrow_table().cast(schema).to_batches()
            con.unregister("texts")
        con.close()

    return run


def same_look(items: DataFrame) -> DataFrame:
    """item (string), text -> item, look: the text in the one form; null stays null, empty stays empty.
    One row a row of `items`; further columns are not carried along."""
    return items.select("item", "text").mapInArrow(_same_look(), "item string, look string")


def _hashed_look() -> object:
    schema = pa.schema([("field", pa.string()), ("item", pa.string()), ("text", pa.string()), ("look", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        sql = look_sql(keep="field, item, text")
        for batch in batches:
            con.register("texts", pa.Table.from_batches([batch]))
            yield from con.sql(sql).to_arrow_table().select(["field", "item", "text", "look"]).cast(schema).to_batches()
            con.unregister("texts")
        con.close()

    return run


def _digest(column: Column | str) -> Column:
    """128 bits of a text, so that texts need not be shuffled."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def look_keys(items: DataFrame) -> DataFrame:
    """field, item, text -> field, item, look_key, text_key: digests of the one form and of the stored text."""
    looks = items.filter("text is not null").select("field", "item", "text").mapInArrow(_hashed_look(), "field string, item string, text string, look string")
    return looks.select("field", "item", _digest("look").alias("look_key"), _digest("text").alias("text_key"))


def same_look_pairs(items: DataFrame) -> DataFrame:
    """field, item, text -> field, key_a, key_b: the items of a field that look the same but are stored
    differently, smaller key first. A repeated (item, text) counts once; null texts pair with nothing.

    First the forms that occur in one stored spelling only are dropped, by least and greatest digest,
    pre-aggregated: most forms, and copies in any number. What is left are the asked-for pairs."""
    keys = materialize(look_keys(items), "looks")
    several = keys.groupBy("field", "look_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("field", "look_key")
    keys = keys.join(several, ["field", "look_key"]).distinct()
    a = keys.select("field", "look_key", F.col("item").alias("key_a"), F.col("text_key").alias("text_a"))
    b = keys.select("field", "look_key", F.col("item").alias("key_b"), F.col("text_key").alias("text_b"))
    return a.join(b, ["field", "look_key"]).filter("key_a < key_b and text_a <> text_b").select("field", "key_a", "key_b").distinct()
