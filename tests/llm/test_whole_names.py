"""Names of any number of parts and any length are compared, and no block loses a pair that the comparison links."""

import random
from itertools import permutations

import pytest

from veritrail.llm import name_variants as N

SEVEN = "Royal Northern Institute for Applied Marine Sciences"


def verdict(a, b):
    x, y = N.parse(a), N.parse(b)
    return x[1] == y[1] or N.compare(x[0], x[2], y[0], y[2])


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (SEVEN, "Royal Northern Inst. for Applied Marine Sciences"), (SEVEN, "Royal Northren Institute for Aplied Marine Sciences"), (SEVEN, "R. Northern Institute for A. Marine Sciences"), ("Acme Widgets", "Acme Widgets Co., Ltd."),
        ("John Tolkien", "John R. R. Tolkien"), ("甲一·乙二·丙三·丁四·戊五", "戊五丁四丙三乙二甲一"), ("赵甲丙·乙二·丙三·丁四·戊五", "钱甲丙·乙二·丙三·丁四·戊五"), ("甲一·乙二·丙三·丁四·戊五", "甲·乙二·丙三·丁四·戊五"),
    ],
)
def test_any_number_of_parts(a, b):
    assert verdict(a, b) and verdict(b, a)


@pytest.mark.parametrize(("a", "b"), [(SEVEN, "Royal Eastern Institute for Applied Marine Sciences"), (SEVEN, "Royal Northern Institute for Applied Sciences"), ("甲一·乙二·丙三·丁四·戊五", "戊五丁四丙三乙二甲二"), ("Acme Widgets", "Acme Widgets Holding Co.")])
def test_any_number_of_parts_that_differ(a, b):
    assert not verdict(a, b) and not verdict(b, a)


def test_many_like_parts_end():
    assert N.agree(["ha"] * 40 + ["x"], ["ha"] * 40 + ["xavier"], 0.8) == ("few", 1.0)
    assert N.agree([f"aaaa{i}" for i in range(10, 40)], [f"aaaa{i}" for i in range(30, 60)], 0.8)
    assert N.is_joined("a" * 300, ["a"] * 300) and not N.is_joined("ab" * 20, ["a"] * 10 + ["b"] * 10 + ["ba"] * 9 + ["bb"])


def some_tokens(rng):
    nick = [*N.NICKNAMES, *N.NICKNAMES.values()]
    other = lambda: "".join(rng.choice("abcj") + rng.choice("aey") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "y"])
    return [rng.choice([rng.choice("abcj"), rng.choice(nick), rng.choice(["incorporated", "company", "of", "university"]), other(), other(), other()]) for _ in range(rng.randint(2, 5))]


def varied(rng, tokens):
    out = []
    for t in tokens:
        at, r = rng.randrange(len(t)), rng.random()
        out.append(t[:at] + rng.choice(["", "a", "y", "n"]) + t[at + rng.choice([0, 1]) :] or t if r < 0.4 else t[0] if r < 0.5 else t[:3] if r < 0.6 else t)
    for _ in range(rng.choice([0, 0, 1, 2])):
        out.insert(rng.randrange(len(out) + 1), rng.choice(["a", "b", "incorporated", "company"]))
    return rng.sample(out, len(out)) if rng.random() < 0.3 else out


def by_force(few, many, ratio=N.RATIO):
    """Every order of the tokens: the scores by which names may agree."""
    scores = set()
    for order in permutations(many, len(few)):
        extra = list(many)
        for y in order:
            extra.remove(y)
        how = [N.same_token(x, y) for x, y in zip(few, order)]
        if None in how or any(len(t) > 1 and t not in N.FORMS for t in extra):
            continue
        if not any(h != "short" or len(x) > 1 and N.NICKNAMES.get(x, x) == N.NICKNAMES.get(y, y) for h, x, y in zip(how, few, order)) or {"short", "slip"} <= set(how):
            continue
        score = sum(N.common_subsequence(x, y) for x, y in zip(few, order)) / sum(max(len(x), len(y)) for x, y in zip(few, order))
        scores |= {1.0} if "short" in how or extra else {score} if score >= ratio else set()
    return max(scores, default=None)


def test_agreement_by_force():
    rng = random.Random(21)
    linked = 0
    for _ in range(1500):
        a = some_tokens(rng)
        few, many = sorted((a, varied(rng, a)), key=len)
        got, score = N.agree(few, many, N.RATIO), by_force(few, many)
        linked += bool(got)
        assert (got and got[1]) == score, (few, many, got, score)
    assert linked > 500


def odd_names(rng):
    """Families of names that agree in part, among them long ones, many parts and ones of initials only."""
    names = {SEVEN, "Royal Northern Inst. for Aplied Marine Sciences", "A B C D E F G H I J K L", "A B C D E F G H I J L", "John A B C D E F G H Smith", "John Smith", "J Smith", "Acme Widgets Co., Ltd.", "Acme Widgets", "Xu Li", "Xu A. B. C. Li"}
    for _ in range(70):
        a = some_tokens(rng)
        names |= {" ".join(x) for x in (a, varied(rng, a), varied(rng, a))}
    for size in (9, 12, 16, 20, 24, 61):  # slips at the first letters too, which leave no common refinement
        t = "".join(rng.choice("abcdefgh") for _ in range(size))
        names |= {t, "x" + t[1:], t[1:] + "x", f"{t} whitfield", f"{t} shitfeild", f"x{t[1:]} whitfeild", f"{t[2:]} whitfield"}
    han = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"
    for size in (12, 14, 18, 22, 30, 75):
        a = "".join(rng.choice(han) for _ in range(size)) + "研究所"
        names |= {a, a[2:], a[1:-4] + a[-3:], a[:3] + a[4:9] + a[10:], a[1:7] + a[8:]}
    for parts in (3, 5, 6):
        a = ["".join(rng.choice(han) for _ in range(3)) for _ in range(parts)]
        names |= {"·".join(a), "".join(a[::-1]), "·".join([a[0][0], *a[1:]]), "·".join([a[0][1:], *a[1:]])}
    return sorted(names)


@pytest.mark.parametrize("block", [N.BLOCK, 1])
def test_blocks_lose_no_pair(spark, block):
    rows = sorted({(p[1], p[0], tuple(p[2])) for n in odd_names(random.Random(22)) if (p := N.parse(n))})
    nodes = list({sig: (sig, kind, list(tokens)) for sig, kind, tokens in rows}.values())
    got = {(r[0], r[1]) for r in N.candidate_pairs(spark.createDataFrame(nodes, "sig string, kind string, tokens array<string>"), block).collect()}
    linked = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if N.compare(a[1], a[2], b[1], b[2])}
    assert len(linked) > 150 and not linked - got, (len(linked), sorted(linked - got)[:10])


def test_names_of_many_parts_are_linked(spark):
    groups = [[SEVEN, "Royal Northern Inst. for Applied Marine Sciences", "Royal Northren Institute for Applied Marine Sciences"], ["甲一·乙二·丙三·丁四·戊五", "戊五丁四丙三乙二甲一"], ["Acme Widgets", "Acme Widgets Co., Ltd."]]
    rows = [(n, 5 if i == 0 else 1) for g in groups for i, n in enumerate(g)]
    got = {r["name"]: r["entity"] for r in N.linked_names(spark.createDataFrame(rows, "name string, n bigint")).collect()}
    assert [len({got[n] for n in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 3
