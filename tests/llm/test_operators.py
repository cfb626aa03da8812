"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import name_variants as N
from veritrail.llm.codes import gram_hashes
from veritrail.llm.leakage import bare, item_sketches, leaked_items, least_common
from veritrail.llm.packing import byte_sized, pack_items, windows
from veritrail.llm.repetition import clean_lines
from veritrail.llm.same_look import look_map, same_look, same_look_pairs
from veritrail.llm.shared_spans import shared_spans
from veritrail.llm.splitting import split_items, split_plan
from veritrail.llm.term_counts import TermStore, latest_texts, marked_terms, pair_deltas, value_deltas

ALPHABET = "甲乙丙丁戊己庚辛壬癸"


def some_text(rng, n, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(n))


def spans_by_force(rows, span):
    windows = defaultdict(set)
    for _, origin, text in rows:
        for i in range(len(text or "") - span + 1):
            windows[text[i : i + span]].add(origin)
    out = {}
    for record, _, text in rows:
        hit = set()
        for i in range(len(text or "") - span + 1):
            if len(windows[text[i : i + span]]) > 1:
                hit.update(range(i, i + span))
        if hit:
            out[record] = len(hit)
    return out


@pytest.mark.parametrize("limit", [100_000, 1])
def test_shared_spans(spark, limit):
    rng = random.Random(limit)
    passages = [some_text(rng, n) for n in (50, 51, 75, 200)]
    rows = [(k, f"o{k % 5}", some_text(rng, rng.randint(0, 90)) + rng.choice([*passages, "", passages[0][1:]]) + some_text(rng, rng.randint(0, 90))) for k in range(60)]
    rows += [(100, None, passages[2]), (101, "o9", None), (102, "o9", ""), (103, "o9", "甲" * 300), (104, "o8", "甲" * 60), (104, "o8", "甲" * 60), (105, "o7", "😀" * 49 + passages[3])]
    df = spark.createDataFrame(rows, "record bigint, origin string, text string").withColumn("prefix", F.lit("clash"))
    got = {r["record"]: r["shared_chars"] for r in shared_spans(df, group_limit=limit).collect()}
    assert got == spans_by_force(rows, 50)
    assert shared_spans(df.limit(0)).count() == 0


def test_deep_nodes_by_force():
    from veritrail.llm.shared_spans import deep_nodes

    rng = random.Random(15)
    for _ in range(40):
        rows = [(rng.randrange(4), rng.randrange(1, 4), some_text(rng, rng.randint(5, 12), "甲乙\U0001F600")) for _ in range(rng.randint(1, 30))]
        windows = defaultdict(set)
        for g, o, t in rows:
            for i in range(len(t) - 4):
                windows[g, t[i : i + 5]].add(o)
        group, origin = (np.array([r[k] for r in rows]) for k in (0, 1))
        text, place = deep_nodes(group, origin, origin, [r[2] for r in rows], 5)
        assert set(zip(text.tolist(), place.tolist())) == {(n, i) for n, (g, _, t) in enumerate(rows) for i in range(len(t) - 4) if len(windows[g, t[i : i + 5]]) > 1}


def test_shared_spans_cross_slices(spark, monkeypatch):
    """A text longer than a slice keeps the spans that lie across the cut."""
    from veritrail.llm.shared_spans import _stretches

    rng = random.Random(5)
    text = some_text(rng, 5000)
    whole = {(int(s), int(n)) for _, start, count, _ in _stretches([text], 50, 16) for s, n in zip(start, count)}
    covered = sorted(p for s, n in whole for p in range(s, s + n))
    assert covered == list(range(len(text) - 49))


def test_name_parts_and_links(spark):
    groups = [
        ["兰渡枣谷交通研究所", "兰渡枣谷交通研所", "交通研究所(兰渡枣谷)", "枣谷交通研究所（兰渡）", "研究所·兰渡枣谷交通", "兰枣交所", "兰枣交老所", "兰枣交通研究所", "兰渡枣谷交所", "兰渡枣谷交​通研究所", "兰枣渡谷交通研究所"],
        ["利坡·加吉朵", "加吉朵·利坡", "加吉朵（利坡）", "利坡 加吉朵", "利坡加吉朵", "利·加吉朵", "阿利·加吉朵", "利坡·嘉吉朵", "利坡·吉加朵"],
        ["Lagan Divotur", "Divotur, Lagan", "DIVOTUR Lagan", "L. Divotur", "Divotur L.", "Lagan-Divotur", "Lanny Divotur", "Lagan Divoturr", "Lagan Dívotur", "Laɡan Divotur".replace("ɡ", "g"), "Ｌagan Divotur"],
        ["Lagan Pemezin"],
        ["兰渡枣谷海洋研究所"],
    ]
    rows = [(n, 10 if k == 0 else 1) for g in groups for k, n in enumerate(g)] + [("显著教师工程", 9), ("显著教师机制", 9), ("显著教师​工程", 1), (None, 3), ("", 2), ("​", 1), ("兰渡枣谷交通研究所", 5)]
    df = spark.createDataFrame(rows, "name string, n bigint").withColumn("sig", F.lit(1))
    got = {r["name"]: r["entity"] for r in N.linked_names(df).collect()}
    for g in groups:
        assert len({got.get(n) for n in g}) == 1, [(n, got.get(n)) for n in g]
    assert len({got[g[0]] for g in groups}) == len(groups)
    assert not any("显著" in n for n in got) and "" not in got
    pairs = {(r[0], r[1]) for r in N.variant_pairs(N.linked_names(df)).collect()}
    assert pairs == {(a, b) for g in groups for a in set(g) for b in set(g) if a < b}
    assert N.variant_pairs(N.linked_names(df.limit(0))).count() == 0


def test_names_of_two_places_stay_apart(spark):
    """One character's difference is a slip only where it is rare among names."""
    names = [f"{p}{q}{f}大学" for p in ("杨青", "桐青", "兰渡") for q in ("枣谷", "柳岭", "棠桃") for f in ("海洋", "政法")]
    got = N.linked_names(spark.createDataFrame([(n, 5) for n in names], "name string, n bigint")).collect()
    assert len({r["entity"] for r in got}) == len(names)


def counts_by_force(now):
    occurrences, records = Counter(), Counter()
    for t in now.values():
        pairs = [t[i : i + 2] for i in range(len(t or "") - 1) if all("一" <= c <= "鿿" for c in t[i : i + 2])]
        occurrences.update(("pair", p) for p in pairs)
        records.update(("pair", p) for p in set(pairs))
        if t:
            occurrences.update([("value", t)])
            records.update([("value", t)])
    full = {k: (occurrences[k], records[k]) for k in occurrences}
    return full | {("pair", None): (len(now),) * 2 if now else None, ("value", None): (sum(1 for t in now.values() if t),) * 2 if any(now.values()) else None}


def test_term_store_lives(spark, tmp_path, monkeypatch):
    """Records are added, changed, emptied and deleted; after each update, by a store opened anew, the counts equal those
    from scratch, totals too; an update without changes counts nothing; a run that was stopped leaves the version before."""
    from veritrail.llm import term_counts

    monkeypatch.setattr(term_counts, "BUCKET_TERMS", 40)
    rng, path = random.Random(3), str(tmp_path / "store")
    now: dict[int, str | None] = {}
    for step in range(4):
        for _ in range(25):
            now[rng.randrange(40)] = rng.choice([None, "", some_text(rng, rng.randint(0, 30)) + "a" + some_text(rng, 3)])
        for key in rng.sample(sorted(now), 5 if step else 0):
            del now[key]
        if step == 3:
            now = {}
        df = spark.createDataFrame(list(now.items()), "key bigint, text string").withColumn("sign", F.lit("clash"))
        store = TermStore(spark, path)
        assert store.version == step + (step > 1)
        read = df.select("key", "text")
        store = store.update({"pair": (read, pair_deltas), "value": (read, value_deltas)})
        got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in TermStore(spark, path).read().collect()}
        assert got == {k: v for k, v in counts_by_force(now).items() if v}
        if step == 1:  # the same again
            again = store.update({"pair": (read, pair_deltas), "value": (read, value_deltas)})
            assert again.parts == store.parts and again.version == store.version + 1
        if now:
            marks = {(r["field"], r["term"]): r["mark"] for r in marked_terms(store.read(), {"pair": 0.3, "value": 0.5}).collect()}
            assert all(marks[k] == ("common" if n > 0.3 * len(now) else "rare" if n == 1 else None) for k, (_, n) in got.items() if k[0] == "pair" and k[1])
    (tmp_path / "store" / "manifest" / "v9").mkdir()
    assert TermStore(spark, path).version == 5


def test_latest_texts(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, None, 1), (3, "x", None), (3, "y", 0), (4, "z", 5), (4, None, 6), (5, "s", 1), (5, "s", 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, ts bigint").withColumn("key", F.lit("clash"))
    assert sorted((r["key"], r["text"]) for r in latest_texts(df.drop("key"), "id", "text", "ts").collect()) == [(1, "c"), (2, None), (3, "y"), (4, None), (5, "s")]


def test_term_store_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "key bigint, text string")
    store = TermStore(spark, str(tmp_path)).update({"pair": (empty, pair_deltas)})
    assert store.read().count() == 0 and marked_terms(store.read(), {"pair": 0.2}).count() == 0


def can_split(text, limit, overlap):
    n = len(text)
    ends = sorted({m.end() for p in (r"\n{2,}", r"[。！？…]+[\n\r]*", r"[.!?][ \t\n\r]+") for m in re.finditer(p, text) if m.end() < n}) + [n]
    reached = [0]
    for e in ends:
        if any(e - (max(0, r - overlap) if r else 0) <= limit for r in reached):
            reached.append(e)
    return n in reached


def test_splitting(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("甲乙丙丁，。. \n！a") if rng.random() < d else "丑" for _ in range(rng.randint(0, 400))) for d in (0.02, 0.1, 0.5) for _ in range(120)]
    for text in texts:
        pieces, kinds = split_plan(text, 60, 15)
        assert all(b - a <= 60 for a, b in pieces)
        assert all(k < 3 for k in kinds) == (len(text) <= 60 or can_split(text, 60, 15))
        built, cut = text[: pieces[0][1]], pieces[0][1]
        for a, b in pieces[1:]:
            assert a == max(0, cut - 15) and b > cut
            built, cut = built + text[cut:b], b
        assert built == text
    long = "丑" * 20000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "短"), (4, long), (5, "甲" * 600), (4, long)], "item_id bigint, text string").withColumn("piece", F.lit(0))
    rows = split_items(df).collect()
    assert {r["item_id"] for r in rows} == {4} and not any(r["natural"] for r in rows) and max(len(r["piece"]) for r in rows) <= 600
    assert split_items(df.limit(0)).count() == 0


def test_same_look(spark):
    same = [("高⽔平", "高水平"), ("Ｋｉtan", "Kitan"), ("Кіtan", "Kitan"), ("理エ", "理工"), ("café", "café"), ("cafe​́", "café"), ("a b　c", "a b c"), ("，｡､", ",。、"), ("料理", "料理"), ("﻿甲⁠", "甲"), ("（１）", "(1)"), ("ﬁn", "fin"), ("Ⅳ".replace("Ⅳ", "Ⅰ"), "I"), ("ｶ", "力")]
    other = [("m²", "m2"), ("cafe", "café"), ("A", "a"), ("8", "B"), ("甲", "乙"), ("工程", "工 程")]
    rows = [(str(k), x) for k, p in enumerate(same + other) for x in p] + [("n", None), ("e", "")]
    looks = defaultdict(list)
    for r in same_look(spark.createDataFrame(rows, "item string, text string").withColumn("look", F.lit(1))).collect():
        looks[r["item"]].append(r["look"])
    for k, p in enumerate(same):
        assert len(set(looks[str(k)])) == 1, (p, looks[str(k)])
    for k, p in enumerate(other, len(same)):
        assert len(set(looks[str(k)])) == 2, p
    assert looks["n"] == [None] and looks["e"] == [""]
    again = same_look(spark.createDataFrame([(k, v) for k, vs in looks.items() for v in vs if v], "item string, text string")).collect()
    assert all(r["look"] in looks[r["item"]] for r in again)
    assert all(len(a) == len(b) == 1 and b not in look_map() for a, b in look_map().items())


def test_same_look_pairs(spark):
    rows = [("f", "1", "高⽔平"), ("f", "2", "高水平"), ("f", "2", "高水平"), ("f", "10", "高水平"), ("g", "3", "高水平"), ("f", "4", None), ("f", "5", ""), ("f", "6", "​"), ("f", "7", "m²")]
    df = spark.createDataFrame(rows, "field string, item string, text string").withColumn("look_key", F.lit(0))
    assert {tuple(r) for r in same_look_pairs(df).collect()} == {("f", "1", "2"), ("f", "1", "10"), ("f", "5", "6")}
    assert same_look_pairs(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([rng.randint(1, 900), rng.randint(1, 6000), 4096, 1])) for k in range(3000)] + [(5000, None), (5001, 0), (5002, 20000), (0, 1)]
    df = spark.createDataFrame(rows, "item_id bigint, size int").withColumn("fill", F.lit("clash"))
    out = pack_items(df, group_size=1000).collect()
    sizes = {}
    for k, s in rows:
        if s:
            sizes[k] = max(s, sizes.get(k, 0))
    fills, parts = Counter(), defaultdict(list)
    for r in out:
        fills[r["container_id"]] += r["size"]
        parts[r["item_id"]].append((r["part_no"], r["part_offset"], r["size"]))
    assert all(r["fill"] == fills[r["container_id"]] <= 4096 for r in out)
    assert {k: sum(p[2] for p in v) for k, v in parts.items()} == sizes
    assert all((len(v) > 1) == (sizes[k] > 4096) for k, v in parts.items())
    assert len(fills) <= 1.02 * -(-sum(sizes.values()) // 4096) + 1
    assert pack_items(df.limit(0)).count() == 0
    assert Counter(r["container_id"] for r in out if r["size"] == 4096).most_common(1)[0][1] == 1


def test_packing_of_texts(spark):
    """A text larger than a container is divided at ends of characters, and the containers' tokens spell the texts."""
    rng = random.Random(16)
    texts = [(k, "".join(rng.choice("甲é😀a") for _ in range(rng.randint(0, 400))), None) for k in range(200)] + [(900, "甲" * 3000, None), (901, "😀é甲a" * 2000, 20001), (902, None, None), (903, "abc", 4), (903, "abc", 4)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, n_tokens int").withColumn("cuts", F.lit("clash"))
    packed = pack_items(byte_sized(docs), group_size=50)
    rows = packed.collect()
    raw = {k: t.encode() for k, t, _ in texts if t is not None}
    parts = defaultdict(list)
    for r in rows:
        parts[r["item_id"]].append((r["part_no"], r["part_offset"], r["size"]))
    for k, v in parts.items():
        v.sort()
        assert all(n <= 4096 for _, _, n in v) and sum(n for _, _, n in v) == len(raw[k]) + 1 and (len(v) > 1) == (len(raw[k]) >= 4096)
        assert all(raw[k][at : at + n].decode() is not None for _, at, n in v)
    assert set(parts) == set(raw)
    made = {r["container_id"]: r for r in windows(packed, docs).collect()}
    assert set(made) == {r["container_id"] for r in rows}
    for key, w in made.items():
        spelled = []
        for k, _, at, n in sorted((r["item_id"], r["part_no"], r["part_offset"], r["size"]) for r in rows if r["container_id"] == key):
            spelled += ([b + 3 for b in raw[k]] + [1])[at : at + n]
        assert list(w["tokens"]) == spelled and len(spelled) <= 4096


def test_leakage(spark):
    rng = random.Random(7)
    letters = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400)) + "abc123é"
    items = [(k, some_text(rng, rng.randint(10, 120), letters)) for k in range(40)] + [(100, None), (101, ""), (102, "短"), (0, "")]
    docs = []
    for k in range(120):
        text = some_text(rng, rng.randint(0, 400), letters)
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(items)[1] or ""
            a, n = rng.randrange(len(t) + 1), rng.randint(10, 70)
            piece = "".join(c + rng.choice(["", "", "，", "\n", "​", " "]) for c in t[a : a + n])
            piece = piece.upper() if rng.random() < 0.5 else unicodedata.normalize("NFD", piece)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + piece.translate({ord(c): ord(c) + 0xFEE0 for c in "abc123"}) + text[at:]
        docs.append((k, text))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    expected = set()
    for i, t in items:
        x = bare(t or "")
        for d, text in docs:
            y = bare(text or "")
            hit = {p + q for p in range(len(x) - 15) if x[p : p + 16] in y for q in range(16)}
            if hit and 2 * len(hit) >= len(x):
                expected.add((d, i))
    schema = ("doc_id bigint, text string", "item_id bigint, text string")
    frames = [spark.createDataFrame(r, s).withColumn("hash", F.lit(1)) for r, s in zip((docs, items), schema)]
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(*frames).collect()} == expected and expected
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(*frames, together=1).collect()} == expected
    assert leaked_items(frames[0].limit(0), frames[1]).count() == 0 and leaked_items(frames[0], frames[1].limit(0)).count() == 0


def leaks_by_force(docs, items):
    out = {}
    for i, t in items:
        x = bare(t or "")
        for d, text in docs:
            y = bare(text or "")
            held = {y[q : q + 16] for q in range(len(y) - 15)}
            hit = {p + q for p in range(len(x) - 15) if x[p : p + 16] in held for q in range(16)}
            if hit and 2 * len(hit) >= len(x):
                out[d, i] = len(hit)
    return out


def test_leakage_of_long_items_by_sketches(spark):
    """Items of which only a part of the shingles is looked up: all leaks are found, at the edge of the share too."""
    rng = random.Random(17)
    letters = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 900))
    phrase = some_text(rng, 40, letters)
    items = [(k, some_text(rng, rng.choice([500, 900, 2000, 6000]), letters)) for k in range(24)] + [(90, phrase * 60), (91, phrase * 60 + some_text(rng, 300, letters))]
    docs = []
    for k in range(60):
        n, text = rng.choice(items)
        kind, pieces = k % 3, []
        if kind == 0:  # the worst case: half of the item in stretches of 16 characters, apart from each other
            pieces = [text[a : a + 16] for a in range(0, len(text), 32 if k % 2 else 33)]
        elif kind == 1:
            pieces = [text[len(text) // 4 : len(text) // 4 + len(text) // 2 + rng.choice([-3, 0, 3])]]
        else:
            pieces = [text[: len(text) // 3], text[-len(text) // 3 :]]
        rng.shuffle(pieces)
        docs.append((k, "".join(some_text(rng, 20, letters) + p for p in pieces)))
    expected = leaks_by_force(docs, items)
    frames = [spark.createDataFrame(r, s) for r, s in zip((docs, items), ("doc_id bigint, text string", "item_id bigint, text string"))]
    assert {(r["doc_id"], r["item_id"]): r["leaked_chars"] for r in leaked_items(*frames).collect()} == expected and len(expected) > 30
    _, sized = item_sketches(frames[1])
    shares = {r["partition"]: r["k"] / r["n"] for r in sized.collect() if r["n"] > 400}
    assert shares[max(shares)] < 0.1 and all(x < 1 for x in shares.values())


def test_least_common_shingles():
    """A phrase that an item repeats covers much of it with few shingles; without repeats each covers 16 characters."""
    for text, least in (("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳" * 50, 1), ("".join(chr(0x4E00 + k) for k in range(320)), 10)):
        codes = np.array(list(map(ord, text)), np.uint32)
        assert least_common(codes, gram_hashes(codes, 16), 16, 0.5) == least


def test_repetition(spark):
    rng = random.Random(8)
    phrases = [some_text(rng, n) for n in (9, 10, 11, 30)]
    texts = ["".join(rng.choice([*phrases, some_text(rng, 7), "\n", "。\n\n"]) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "甲" * 3000, "a|b|c\n", "短", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_chars", F.lit("clash"))
    got = {r["doc_id"]: r for r in clean_lines(df).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        text, seen, hit = text or "", set(), set()
        for i in range(len(text) - 9):
            if text[i : i + 10] in seen:
                hit.update(range(i, i + 10))
            seen.add(text[i : i + 10])
        row, lines, at = got[k], re.findall(r"[^\n]*\n|[^\n]+", text), 0
        fails, kept = Counter(), ""
        for line in lines:
            part = sum(p in hit for p in range(at, at + len(line)))
            at += len(line)
            shown = line.rstrip()
            rules = {"boilerplate": part and part >= 0.15 * len(line), "navigation": shown and len(line) <= 40 and line.count("|") > 1}
            rules["punctuation"] = shown and shown[-1] != "。"
            fails.update(r for r, x in rules.items() if x)
            fails["chars"] += len(line) * bool(rules["boilerplate"])
            kept += "" if any(rules.values()) else line
        assert (row["n_chars"], row["repeated_chars"], row["n_lines"], row["cleaned"], row["lost_chars"]) == (len(text), len(hit), len(lines), kept, len(text) - len(kept))
        assert [row[f"{r}_lines"] for r in ("boilerplate", "punctuation", "navigation")] == [fails[r] for r in ("boilerplate", "punctuation", "navigation")]
        assert row["boilerplate_chars"] == fails["chars"] and row["rejected"] == (text != "" and len(hit) >= 0.3 * len(text))
    assert got[len(texts) - 3]["navigation_lines"] == 1 and sum(r["rejected"] for r in got.values()) > 20
    assert {r["doc_id"] for r in clean_lines(df, cleaned=False).filter("rejected").collect()} == {k for k, r in got.items() if r["rejected"]}
    assert clean_lines(df.limit(0)).count() == 0


def test_repetition_survives_equal_hashes(monkeypatch):
    """With a hash that says nothing the counts are still exact."""
    from veritrail.llm import repetition

    monkeypatch.setattr(repetition, "gram_hashes", lambda codes, n: np.full(max(0, codes.size - n + 1), 3, np.uint64))
    codes = np.frombuffer("甲乙丙丁戊己庚辛壬癸子甲乙丙丁戊己庚辛壬癸丑".encode("utf-32-le"), np.uint32)
    hit = repetition.repeated_characters(codes, np.array([codes.size]), np.zeros(codes.size, np.int64), 10)
    assert list(np.flatnonzero(hit)) == list(range(11, 21))
