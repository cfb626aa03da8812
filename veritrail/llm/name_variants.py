"""Problem 2: linking the spellings of one person or organisation.

1. Each distinct string is brought to one look and cut into tokens. Order of the parts, brackets, separators, capitals,
   accents and legal forms are levelled to a signature; strings of one signature are one node.
2. Suffix blocking. The suffixes of a name's tokens, of a minimum length, are index keys. A suffix that too many
   names have is refined with the other fields (first letters of the other tokens, then of its own), and only its
   unrefined form is discarded; the last refinement stays whatever its size. Beside them stand keys by which any two names
   that step 3 links meet, whatever suffixes are common: the whole name with one character left out, or several in long
   names; for short forms the first character, a later one and the last, or a Latin token and the initials of all;
   for slips in Latin names the groups of tokens that slips lead to, refined by what is left of the tokens themselves.
3. Pairs that share a key are compared by the ratio of their longest common subsequence. Full names of a ratio of at
   least `ratio` are one, except where they differ by a substitution that is no slip: both characters are
   usual among names, or both are numerals or directions. A name that follows a longer one in order, skipping at
   most one character of each word, or by initials, nicknames and cut-off tokens, is a short form of it. Tokens stand in any
   order, and may be any number: which goes with which is an assignment problem, solved exactly.
4. A short form joins the one longer name that fits best. Components are found by iterated minimum labels over
   tables in the shared folder.

Words that decide what a string is (kinds of organisation, legal forms, nicknames) are fixed lists of common words. No rule
asks how long a name or its parts are, beyond the least length at which a slip can be told from another name.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORY_WORDS
from ..session import materialize
from .same_look import INVISIBLE, look_map

# Words that end the name of an organisation.
TYPES = (
    "研究院 研究所 研究中心 实验室 委员会 基金会 办公室 出版社 事务所 合作社 俱乐部 博物馆 图书馆 工作室 科学院 工程院 设计院 大学 学院 学校 中学 小学 医院 银行 中心 联盟 协会 学会 商会 "
    "集团 公司 机构 部门 法院 检察院 管理局 总局 工厂 剧院 报社 书店 酒店 党校 支队 总队 联合会 促进会 理事会"
).split()
# Legal forms at the end of a name, which don't tell organisations apart.
LEGAL = "股份有限公司 有限责任公司 有限公司".split()
# Latin words of organisations, and their abbreviations.
WORDS = {
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "co": "company", "univ": "university", "inst": "institute", "dept": "department", "lab": "laboratory", "labs": "laboratory",
    "intl": "international", "assoc": "association", "assn": "association", "natl": "national", "acad": "academy", "bros": "brothers", "mfg": "manufacturing", "tech": "technology", "govt": "government",
}
# Common English nicknames and the names that they stand for.
NICKNAMES = {
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "dick": "richard", "rick": "richard", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "ted": "edward", "ned": "edward", "ed": "edward", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "betty": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine",
    "kitty": "katherine", "tom": "thomas", "tony": "anthony", "chuck": "charles", "charlie": "charles", "harry": "henry", "hank": "henry", "larry": "lawrence", "mike": "michael", "nick": "nicholas",
    "polly": "mary", "molly": "mary", "sally": "sarah", "steve": "stephen", "gene": "eugene", "jerry": "gerald", "andy": "andrew", "drew": "andrew", "fred": "frederick", "gus": "augustus", "hal": "henry",
}
# Familiar additions to a short form; small words that initials leave out; characters that count or point.
FAMILIAR, SMALL = "阿老小", {"of", "the", "and", "for", "in", "de", "la"}
# Latin legal forms, which may stand beyond a name.
FORMS = {"incorporated", "limited", "company", "corporation", "llc", "plc"}
COUNTING = set("0123456789一二三四五六七八九十百千甲乙丙丁东西南北上下左右前后大小新")

RATIO = 0.8
#: The least suffix indexed, in Chinese and Latin characters; names at a key beyond which it is refined.
LEAST_SUFFIX, LEAST_LATIN, BLOCK = 3, 3, 64
#: Tokens with more than one initial, or none, up to which all initials of a name are written as keys; names with more meet
#: every name that has a token in common.
MOST_CHOICES = 6
_INVISIBLE = {c: None for a, b in INVISIBLE for c in range(a, b + 1)}
_HAN = re.compile(r"[一-鿿]")
_TYPES = sorted(TYPES, key=len, reverse=True)
_GENERIC = tuple(w for w in CATEGORY_WORDS if w not in TYPES)


@cache
def _look() -> dict[int, str | None]:
    return {ord(a): b for a, b in look_map().items()} | _INVISIBLE


def one_look(name: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", name).translate(_look()))).strip()


def folded(token: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def type_of(name: str) -> str:
    """The word that ends an organisation's name; empty if there is none, or nothing else."""
    return next((t for t in _TYPES if name.endswith(t) and len(name) > len(t)), "")


def parse(name: str) -> tuple[str, str, list[str]] | None:
    """kind (org, han, latin, plain), signature and tokens; None for what names nobody: nothing visible, or
    a general term such as a plan, task or mechanism. An organisation in Chinese is two tokens, stem and type."""
    s = one_look(name)
    if not re.search(r"\w", s):
        return None
    if not _HAN.search(s):
        m = re.fullmatch(r"([^,]+),\s*(.+)", s)
        tokens = [folded(t).strip(",()·") for t in re.split(r"[\s\-·()/]+", f"{m[2]} {m[1]}" if m and not re.fullmatch(r"(?i)(inc|ltd|llc|corp|co)\.?", m[2]) else s)]
        tokens = [t if re.fullmatch(r"\w\.?", t) else t.strip(".") for t in tokens]
        tokens = [WORDS.get(t, t).rstrip(".") for t in tokens if t.strip(".")]
        if not tokens:
            return None
        kind = "latin" if len(tokens) > 1 else "plain"
        return kind, f"{kind}:{'|'.join(sorted(tokens))}", tokens
    m = re.fullmatch(r"([^()]+)\(([^()]+)\)", s)
    tokens = [t for t in re.split(r"[\s·]+", f"{m[2]} {m[1]}" if m else s) if t]
    if len(tokens) > 1:
        typed = [bool(type_of(t)) or t in TYPES for t in tokens]
        if not any(typed):
            return "han", f"han:{'|'.join(sorted(tokens))}", sorted(tokens)
        tokens = [t for t, x in zip(tokens, typed) if not x] + [t for t, x in zip(tokens, typed) if x]
    s = "".join(tokens)
    for form in LEGAL:
        if s.endswith(form) and len(s) > len(form) + 2:
            s = s[: -len(form)]
            break
    kind = type_of(s)
    if kind:
        return "org", "org:" + s, [s[: -len(kind)], kind]
    if s.endswith(_GENERIC):
        return None
    return "plain", "plain:" + s, [s]


def _less_one(text: str) -> set[str]:
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def _beginnings(text: str, deleted: int, length: int) -> set[str]:
    """What a text may begin with, up to a length, once at most `deleted` characters are left out. Two texts of which no more
    is left out than that for each to be their longest common subsequence have its beginning in common."""
    head = text[: length + deleted]
    least = deleted if len(head) == length + deleted else 0  # of a longer text, what is left in is cut off at the end
    return {"".join(kept)[:length] for n in range(least, min(deleted, len(head)) + 1) for kept in combinations(head, len(head) - n)}


def slip_keys(token: str) -> set[str]:
    """Keys that a Latin token shares with every token that is equal to it or a slip of it (same_token): at most a quarter
    of either is outside of their common subsequence. Longer tokens have more ways to be slips, and give shorter beginnings."""
    size = len(token)
    lengths = {6 if n < 20 else 3 if n < 60 else 1 for n in (size, size * 4 // 3)}
    return {f"{n}:{x}" for n in lengths for x in (set(token[: size // 4 + 1]) if n == 1 else _beginnings(token, size // 4, n))}


def _omission_keys(whole: str) -> set[str]:
    """Keys that a Chinese name shares with the names from which it differs by two or more characters put in or left out."""
    size = len(whole)
    length = lambda n: n if n < 20 else 6 if n < 30 else 3 if n < 75 else 1
    keys = {f"{n}:{whole[: length(n)]}" for n in range(size + 2, size * 5 // 4 + 1) if n - size <= n // 5 - 1}
    if size >= 15:
        most = size // 5 - 1
        keys |= {f"{size}:{x}" for x in (set(whole[: most + 1]) if length(size) == 1 else _beginnings(whole, most, length(size)))}
    return keys


def _short(text: str) -> str:
    """Without familiar additions, where something else is left."""
    return "".join(c for i, c in enumerate(text) if c not in FAMILIAR or i == len(text) - 1) if len(text) > 2 else text


def block_keys(kind: str, tokens: list[str], level: int = 2) -> set[tuple[str, str, str]]:
    """The index keys of a name, each with its refinements up to a level. Any two names that `compare` links have
    a key of the last level in common, so that a pair is lost neither by a common key nor by the number of tokens."""
    keys: set[tuple[str, str, str]] = set()
    fixed = lambda k: keys.add((k, k, k))
    han = kind in ("org", "han") or bool(_HAN.search(tokens[0]))
    whole = "".join(tokens)
    least = LEAST_SUFFIX if han else LEAST_LATIN
    for i, token in enumerate(tokens):
        others = sorted({NICKNAMES.get(t, t)[0] for j, t in enumerate(tokens) if j != i} | {t[0] for j, t in enumerate(tokens) if j != i}) or [""]
        if kind == "org":
            if i == 1:  # a type word alone is refined at once, by the stem less one character
                continue
            others = [tokens[0][0]]
        for at in range(len(token) - least + 1):
            suffix = f"{'h' if han else 'l'}:{token[at:]}"
            for o in others:
                keys.add((suffix, f"{suffix}|{o}", f"{suffix}|{o}|{token[0]}"))
    if han and kind != "han":
        for x in _less_one(whole):
            fixed("1:" + x)
        for x in _omission_keys(whole):
            fixed("o:" + x)
        fixed("a:" + "".join(sorted(whole)))
        for bare in {whole, _short(whole)}:
            if len(bare) > 1:
                k = f"s:{bare[0]}{bare[1]}{bare[-1]}"
                keys.add((k, f"{k}|{bare[2:3]}", f"{k}|{bare[2:4]}"))
        if kind == "org":
            # as the longer name: the first character, one or two later ones in order, the last
            stem, word = tokens
            for end in set(word):
                for j in range(1, len(whole)):
                    if whole[j] == end or j < len(whole) - 1:
                        k = f"s:{whole[0]}{whole[j]}{end}"
                        later = {whole[n : n + 1] for n in range(j + 1, min(j + 3, len(whole)))} | {end, "", *word}
                        for a in later:
                            keys.add((k, f"{k}|{a}", f"{k}|{a}"))
                            for n in range(j + 1, len(whole)):
                                if whole[n] == a:
                                    for b in {whole[m : m + 1] for m in range(n + 1, min(n + 3, len(whole)))} | {end, *word}:
                                        keys.add((k, f"{k}|{a}", f"{k}|{a}{b}"))
            if len(stem) >= 3:
                fixed("=:" + stem)
        elif len(whole) >= 3:
            fixed("=:" + whole)
    elif kind == "han":
        fixed("a:" + "".join(sorted(whole)))
        for i, t in enumerate(tokens):
            for x in _less_one(t):
                fixed("2:" + "|".join(sorted([*tokens[:i], *tokens[i + 1 :]])) + "|" + x)
            fixed("i:" + "|".join(sorted([*tokens[:i], *tokens[i + 1 :]])) + "|" + _initial(t))
    else:
        for i, t in enumerate(tokens):
            rest = "|".join(sorted([*tokens[:i], *tokens[i + 1 :]]))
            for x in _less_one(t):
                fixed(f"2:{rest}|{x}")
            if len(tokens) > 1:
                for x in {t[0], NICKNAMES.get(t, t)[0]}:
                    fixed(f"i:{rest}|{x}")
        if len(tokens) == 1:
            for x in slip_keys(tokens[0]):
                fixed("t:" + x)
        for i, t in enumerate(tokens if len(tokens) > 1 else []):
            # a token of full length and the initials of all; of names with many optional tokens see candidate_pairs
            k = "e:" + NICKNAMES.get(t, t)
            for x in _initials(tokens, i) if level else {""}:
                keys.add((k, f"{k}|{x}", f"{k}|{x}"))
        letters = "".join(t[0] for t in tokens if t not in SMALL)
        if len(letters) > 2:
            fixed("@:" + letters)
        if len(tokens) == 1 and len(tokens[0]) > 2:
            fixed("@:" + tokens[0])
    return keys


def _needed(token: str) -> bool:
    """Whether a Latin token is no initial and no legal form, so that it must have its like in the other name."""
    return len(token) > 1 and token not in FORMS


def _choices(token: str) -> list[str]:
    """What a Latin token adds to the initials by which short forms meet: its own or its nickname's, nothing if it is optional."""
    return list(dict.fromkeys([token[0], NICKNAMES.get(token, token)[0], *([] if _needed(token) else [""])]))


def _open(tokens: list[str]) -> bool:
    """Whether a Latin name has too many choices of initials to write all of them."""
    return sum(len(_choices(t)) > 1 for t in tokens) > MOST_CHOICES


def _initials(tokens: list[str], kept: int) -> set[str]:
    """The initials of a name, with any of its optional tokens left out but the one that is kept; none if there are too many."""
    if _open(tokens):
        return set()
    return {"".join(sorted(x)) for x in product(*([x for x in _choices(t) if x or i != kept] for i, t in enumerate(tokens)))}


def like_keys(tokens: list[str], likes: list[str], sizes: list[int], level: int) -> set[tuple[str, str, str]]:
    """Keys that Latin names share if each token is equal to the other's or a slip of it. `likes` are the tokens' groups (see
    token_groups), empty for one that may be left out: the groups of two such names are the same. They are refined by
    what the tokens of the largest group have in common, then those of the next."""
    groups = sorted({(-size, like) for like, size in zip(likes, sizes) if like})
    if not groups:
        return {(k, k, k) for k in ("c:" + t for t in tokens)}
    k = "c:" + "|".join(sorted(filter(None, likes)))
    if not level:
        return {(k, "", "")}
    of = lambda group: [i for i, like in enumerate(likes) if like == group]
    first = of(groups[0][1])
    second = first if len(first) > 1 else of(groups[1][1]) if len(groups) > 1 else []
    keys = set()
    for i in first:
        beside = set().union(*(slip_keys(tokens[j]) for j in second if j != i)) if level == 2 else set()
        keys |= {(k, f"{k}|{x}", f"{k}|{x}|{y}") for x in slip_keys(tokens[i]) for y in beside or {""}}
    return keys


def _initial(token: str) -> str:
    """The character that a short form of a Chinese token keeps: the one behind a familiar addition, else the first."""
    return token[1] if len(token) == 2 and token[0] in FAMILIAR else token[0]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & places.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def substitution(a: str, b: str) -> tuple[str, str, int] | None:
    """The two characters and the place, if strings of one length differ in one place only."""
    at = [i for i in range(len(a)) if a[i] != b[i]] if len(a) == len(b) else []
    return (a[at[0]], b[at[0]], at[0]) if len(at) == 1 else None


def swapped(a: str, b: str) -> bool:
    """Whether strings of one length differ by two neighbouring characters in the other order only."""
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def is_short(short: str, stem: str, word: str) -> bool:
    """Whether a string follows an organisation's name: from its first character, in order, skipping at most one
    character of the stem at a time, to a character of the type word. Familiar additions may stand in it."""
    whole = stem + word
    for s in {short, _short(short)}:
        if not 2 <= len(s) < len(whole) or s[0] != whole[0] or s[-1] not in word:
            continue
        ends = {0}  # where the characters so far may have ended
        for i, c in enumerate(s[1:], 1):
            after = set()
            for p in ends:
                skip = min(p + 2, len(stem) - 1)
                reach = range(p + 1, len(whole) if p + 2 >= len(stem) else skip + 1)
                after |= {q for q in reach if whole[q] == c}
            ends = after
        if any(p >= len(stem) for p in ends):
            return True
    return False


def same_token(a: str, b: str) -> str | None:
    """How two Latin tokens agree: equal, short (initial, nickname, diminutive, cut off), slip; else None."""
    if a == b:
        return "equal"
    if min(len(a), len(b)) == 1:
        return "short" if a[0] == b[0] else None
    x, y = sorted((a, b), key=len)
    if NICKNAMES.get(a, a) == NICKNAMES.get(b, b):
        return "short"
    if len(x) > 2 and y.startswith(x):
        return "slip" if len(y) - len(x) == 1 and len(x) > 3 else "short"
    if a[:2] == b[:2] and min(len(a), len(b)) > 3 and (a.endswith(("y", "ie")) != b.endswith(("y", "ie"))):
        if common_subsequence(a, b) / max(len(a), len(b)) < RATIO:
            return "short"
    if len(y) > 3 and common_subsequence(a, b) / len(y) >= 0.75:
        return "slip"
    if len(a) == len(b) > 3 and sorted(a) == sorted(b) and common_subsequence(a, b) == len(a) - 1:
        return "slip"
    return None


def assignment(weights: list[dict[int, int]], needed: set[int]) -> list[int] | None:
    """For each row the column that it takes: each column once at most, the needed ones all, of those that a row has a weight for,
    with the greatest sum. None if that can't be. Exact at any size, by shortest augmenting paths in each connected part."""
    if needed - {c for row in weights for c in row} or not all(weights):
        return None
    taken, todo = [-1] * len(weights), set(range(len(weights)))
    by_column: dict[int, list[int]] = {}
    for r, row in enumerate(weights):
        for c in row:
            by_column.setdefault(c, []).append(r)
    while todo:
        rows, columns, open_rows = [], set(), [todo.pop()]
        while open_rows:
            rows.append(open_rows.pop())
            for c in weights[rows[-1]].keys() - columns:
                columns.add(c)
                more = todo.intersection(by_column[c])
                todo -= more
                open_rows += more
        rows, cols = sorted(rows), sorted(columns)
        if len(rows) > len(cols):
            return None
        # a needed column outweighs all weights, a column that a row can't take outweighs everything
        unit = 1 + 2 * sum(max(map(abs, weights[r].values())) for r in rows)
        cost = [[-weights[r][c] - unit * (c in needed) if c in weights[r] else unit * (len(rows) + 2) for c in cols] for r in rows]
        for r, c in zip(rows, _least_cost(cost)):
            if cols[c] not in weights[r]:
                return None
            taken[r] = cols[c]
    return None if needed - set(taken) else taken


def _least_cost(cost: list[list[int]]) -> list[int]:
    """The Hungarian method: the column of each row, no more rows than columns."""
    wide = len(cost[0])
    of_row, of_column, holder = [0] * (len(cost) + 1), [0] * (wide + 1), [0] * (wide + 1)  # row and column 0 are none
    for start in range(1, len(cost) + 1):
        holder[0], at = start, 0
        least, came, seen = [float("inf")] * (wide + 1), [0] * (wide + 1), [False] * (wide + 1)
        while True:
            seen[at] = True
            row, step, to = holder[at], float("inf"), 0
            for c in range(1, wide + 1):
                if not seen[c]:
                    over = cost[row - 1][c - 1] - of_row[row] - of_column[c]
                    if over < least[c]:
                        least[c], came[c] = over, at
                    if least[c] < step:
                        step, to = least[c], c
            for c in range(wide + 1):
                if seen[c]:
                    of_row[holder[c]] += step
                    of_column[c] -= step
                else:
                    least[c] -= step
            at = to
            if not holder[at]:
                break
        while at:
            holder[at] = holder[came[at]]
            at = came[at]
    taken = [0] * len(cost)
    for c in range(1, wide + 1):
        if holder[c]:
            taken[holder[c] - 1] = c - 1
    return taken


def is_joined(text: str, tokens: list[str]) -> bool:
    """Whether a text is the tokens one after another, in some order."""
    if sorted(text) != sorted("".join(tokens)):
        return False
    start = tuple(sorted(tokens))
    todo, seen = [start], {start}
    while todo:
        left = todo.pop()
        if not left:
            return True
        at = len(text) - sum(map(len, left))
        for i, t in enumerate(left):
            rest = left[:i] + left[i + 1 :]
            if text.startswith(t, at) and rest not in seen:
                seen.add(rest)
                todo.append(rest)
    return False


def agree(few: list[str], many: list[str], ratio: float) -> tuple[str, float] | None:
    """How Latin names of two or more tokens agree: (same, score), or (few or many, 1) for the one that is a short form of
    the other; else None. Every token of `few` has its like, in any order, one at least of full length; beyond them
    `many` has initials and legal forms only. Any number of tokens."""
    needed = {c for c, y in enumerate(many) if _needed(y)}
    if len(needed) > len(few):
        return None
    like = [{c: how for c, y in enumerate(many) if (how := same_token(x, y))} for x in few]
    if not all(like) or needed - {c for row in like for c in row}:
        return None
    full = [{c: how for c, how in row.items() if how != "short"} for row in like]
    if len(many) > len(few) and assignment([dict.fromkeys(row, 0) for row in full], needed):
        return "few", 1.0
    # without slips: short forms, of which not all may be cut off
    weight = lambda x, y, how: 2 if how == "equal" else int(len(x) > 1 and NICKNAMES.get(x, x) == NICKNAMES.get(y, y))
    order = assignment([{c: weight(x, many[c], how) for c, how in row.items() if how != "slip"} for x, row in zip(few, like)], needed)
    how = [like[r][c] for r, c in enumerate(order or [])]
    if order and "short" in how and any(weight(x, many[c], h) for x, c, h in zip(few, order, how)):
        shorter = "few" if sum(map(len, few)) <= sum(len(many[c]) for c in order) else "many"
        # a nickname may be the longer string; by its list or ending it is the short form all the same
        for x, y in zip(few, (many[c] for c in order)):
            if x in NICKNAMES and NICKNAMES[x] == y or x.endswith(("y", "ie")) and not y.startswith(x) and len(x) > 1 and x[:2] == y[:2]:
                shorter = "few"
            elif y in NICKNAMES and NICKNAMES[y] == x or y.endswith(("y", "ie")) and not x.startswith(y) and len(y) > 1 and x[:2] == y[:2]:
                shorter = "many"
        return shorter, 1.0
    if len(many) > len(few):
        return None
    # the greatest ratio of the sums: weigh by the ratio reached until none is greater
    sizes = [{c: (common_subsequence(x, many[c]), max(len(x), len(many[c]))) for c in row} for x, row in zip(few, full)]
    common, longest = 0, 1
    while order := assignment([{c: n * longest - size * common for c, (n, size) in row.items()} for row in sizes], set()):
        n, size = (sum(sizes[r][c][k] for r, c in enumerate(order)) for k in (0, 1))
        if n * longest <= size * common:
            break
        common, longest = n, size
    return ("same", common / longest) if order and common / longest >= ratio else None


def compare(kind_a: str, a: list[str], kind_b: str, b: list[str], ratio: float = RATIO) -> tuple[str, float, str, str] | None:
    """How two names agree: (same, score, two substituted characters or empty), or (a or b, score, ...) for the one
    that is a short form of the other; else None."""
    whole_a, whole_b = "".join(a), "".join(b)
    if {kind_a, kind_b} <= {"org", "plain"} and _HAN.search(whole_a) and _HAN.search(whole_b):
        common, (least, longest) = common_subsequence(whole_a, whole_b), sorted((len(whole_a), len(whole_b)))
        if common / longest >= ratio and longest >= (5 if kind_a == kind_b == "plain" else 4):
            sub = substitution(whole_a, whole_b)
            if sub:
                x, y, at = sub
                counted = {x, y} <= COUNTING or kind_a == kind_b == "org" and a[1] != b[1] and at >= len(a[0])
                return None if counted else ("same", common / longest, x, y)
            # characters put in or left out, or two neighbours in the wrong order
            if common == least and longest > least and longest - least <= max(1, longest // 5 - 1) or least == longest and common == least - 1 and swapped(whole_a, whole_b):
                return "same", common / longest, "", ""
        for side, short, kinds, long in (("a", whole_a, (kind_a, kind_b), b), ("b", whole_b, (kind_b, kind_a), a)):
            if kinds[1] == "org" and (is_short(short, *long) or kinds[0] == "plain" and short == long[0] and len(short) > 2):
                return side, 1.0, "", ""
        return None
    if "han" in (kind_a, kind_b) and {kind_a, kind_b} <= {"han", "plain", "org"}:
        if kind_a != kind_b:
            side, short, long = ("a", whole_a, b) if kind_b == "han" else ("b", whole_b, a)
            return (side, 1.0, "", "") if is_joined(short, long) else None
        odd_a, odd_b = (list((Counter(x) - Counter(y)).elements()) for x, y in ((a, b), (b, a)))
        if len(odd_a) != 1 or len(odd_b) != 1:
            return None
        x, y = odd_a[0], odd_b[0]
        for side, s, long in (("a", x, y), ("b", y, x)):
            if len(s) == 1 and len(long) > 1 and s == long[0] or len(s) == 2 and s[0] in FAMILIAR and len(long) > 1 and s[1] == long[0]:
                return side, 1.0, "", ""
        common, longest = common_subsequence(x, y), max(len(x), len(y))
        score = (len(whole_a) + common - len(x)) / (len(whole_a) - len(x) + longest)
        # a token of two characters is too short to tell a slip from another name
        return ("same", score, "", "") if longest > 2 and common >= longest - 1 and score >= min(ratio, 0.75) else None
    if _HAN.search(whole_a) or _HAN.search(whole_b):
        return None
    if len(a) == 1 or len(b) == 1:
        if len(a) == len(b):
            score = common_subsequence(whole_a, whole_b) / max(len(whole_a), len(whole_b))
            return ("same", score, "", "") if score >= ratio and max(len(whole_a), len(whole_b)) > 5 else None
        side, short, long = ("a", whole_a, b) if len(a) == 1 else ("b", whole_b, a)
        return (side, 1.0, "", "") if len(short) > 2 and short == "".join(t[0] for t in long if t not in SMALL) else None
    few, many, sides = (a, b, {"few": "a", "many": "b"}) if len(a) <= len(b) else (b, a, {"few": "b", "many": "a"})
    found = agree(few, many, ratio)
    return (sides.get(found[0], "same"), found[1], "", "") if found else None


_NODE = "name string, n bigint, sig string, kind string, tokens array<string>"
_PAIR = "sig_a string, sig_b string, n_a bigint, n_b bigint, how string, score double, char_a string, char_b string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("name", pa.string()), ("n", pa.int64()), ("sig", pa.string()), ("kind", pa.string()), ("tokens", pa.list_(pa.string()))])
    for batch in batches:
        names = zip(batch.column("name").to_pylist(), batch.column("n").to_pylist())
        yield _batch([(name, n, p[1], p[0], p[2]) for name, n in names if (p := parse(name)) is not None], schema)


def _keyed(level: int):
    """Keys of a name: of level 0 unrefined, of level 1 or 2 as refined, with the coarser ones that they come from."""
    names = ("key", "finer", "finest")[: level + 1]
    schema = pa.schema([("sig", pa.string()), *((n, pa.string()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sig, kind, tokens, likes, sizes in zip(*(batch.column(c).to_pylist() for c in ("sig", "kind", "tokens", "likes", "sizes"))):
                keys = block_keys(kind, tokens, level) | (like_keys(tokens, likes, sizes, level) if likes else set())
                rows += [(sig, *k) for k in sorted({k[: level + 1] for k in keys})]
            yield _batch(rows, schema)

    return run


def _token_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("token", pa.string()), ("key", pa.string())])
    for batch in batches:
        yield _batch([(t, k) for t in batch.column("token").to_pylist() for k in sorted(slip_keys(t))], schema)


def _slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        yield _batch([(a, b) for a, b in pairs if same_token(a, b) == "slip"], schema)


def _are_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sig", pa.string())])
    for batch in batches:
        yield _batch([(sig,) for sig, tokens in zip(batch.column("sig").to_pylist(), batch.column("tokens").to_pylist()) if _open(tokens)], schema)


def _compared(ratio: float):
    names = ("sig_a", "kind_a", "tokens_a", "n_a", "sig_b", "kind_b", "tokens_b", "n_b")
    schema = pa.schema([("sig_a", pa.string()), ("sig_b", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("how", pa.string()), ("score", pa.float64()), ("char_a", pa.string()), ("char_b", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sa, ka, ta, na, sb, kb, tb, nb in zip(*(batch.column(c).to_pylist() for c in names)):
                found = compare(ka, ta, kb, tb, ratio)
                if found:
                    rows.append((sa, sb, na, nb, *found))
            yield _batch(rows, schema)

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node) for the nodes of undirected edges, by iterated minimum labels
    with shortcuts; each round is a table in the shared folder."""
    both = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label")
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        joined = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = materialize(joined.join(far, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("after")), "labels")
        labels = after.select("node", F.col("after").alias("label"))
        if after.filter("label <> after").isEmpty():
            return labels.withColumnRenamed("label", "component")


def is_slip(slip: int) -> Column:
    """Whether two names that differ in one character are one. They aren't if either character is usual among full
    names (support: names that have it; together: pairs of names that differ by just these two). They are one if a
    character stands in no other name, or is rare beside the other one, or if the rarer name stands at most half as often
    and its character is rare where the two don't stand side by side; at an eighth it may stand in one other name."""
    low, high = F.least("support_a", "support_b"), F.greatest("support_a", "support_b")
    a_rarer = F.col("n_a") < F.col("n_b")
    apart = lambda s: F.col(f"support_{s}") - F.col("together")
    rare, usual = F.when(a_rarer, apart("a")).otherwise(apart("b")), F.when(a_rarer, apart("b")).otherwise(apart("a"))
    seldom = lambda times: F.least("n_a", "n_b") * times <= F.greatest("n_a", "n_b")
    beside = (rare * slip <= usual) & ((usual > 0) | (high == 1))
    return (low <= 1) | (low * slip <= high) | seldom(2) & beside | seldom(8) & (rare <= 1) & (rare < usual)


def token_groups(nodes: DataFrame) -> DataFrame:
    """sig, likes, sizes: for each token of a Latin name of several the group of tokens that slips lead to, and how many the
    group has. The group is empty for initials and where a legal form is in it, since such tokens may be left out."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = nodes.filter("kind = 'latin'").select("sig", F.posexplode("tokens").alias("at", "token"))
    tokens = materialize(each.select("token").distinct(), "tokens")
    keys = materialize(tokens.repartition(parts, "token").mapInArrow(_token_keys, "token string, key string"), "token-keys")
    a, b = keys.select("key", F.col("token").alias("a")), keys.select("key", F.col("token").alias("b"))
    slips = materialize(a.join(b, "key").filter("a < b").select("a", "b").distinct().repartition(parts, "a", "b").mapInArrow(_slips, "a string, b string"), "slips")
    grouped = tokens.join(components(slips, "a", "b").withColumnRenamed("node", "token"), "token", "left").select("token", F.coalesce("component", "token").alias("like"))
    sized = grouped.groupBy("like").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.col("token").isin(*FORMS) | (F.length("token") < 2)).alias("_optional"))
    grouped = materialize(grouped.join(sized, "like").select("token", F.when(F.col("_optional"), "").otherwise(F.col("like")).alias("like"), "size"), "token-groups")
    rows = each.join(grouped, "token").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("at", "like", "size"))).alias("_rows"))
    return rows.select("sig", F.col("_rows.like").alias("likes"), F.col("_rows.size").alias("sizes"))


def candidate_pairs(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """sig_a, sig_b: names that share a key, smaller first, among them all that `compare` links. A key that more than `block`
    names have is refined, and only names that have such keys are cut into refined ones."""
    # by number: names are little data and much work
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = materialize(nodes.select("sig", "kind", "tokens").join(token_groups(nodes), "sig", "left"), "keyed-nodes")
    columns, levels, used, common, some = ["key", "finer", "finest"], 3, None, None, nodes
    for level in range(levels):
        name = columns[level]
        keys = some.repartition(parts, "sig").mapInArrow(_keyed(level), ", ".join(f"{c} string" for c in ("sig", *columns[: level + 1])))
        if common is not None:  # of the finer keys those that come from a common one
            keys = keys.join(common, columns[level - 1], "left_semi")
        keys = materialize(keys.select("sig", F.col(name)).distinct(), "keys")
        mine = keys.select("sig", F.col(name).alias("key"))
        if level == 0:
            unrefined = mine.filter("key like 'e:%'")
        if level < levels - 1:
            common = materialize(keys.groupBy(name).agg(F.count(F.lit(1)).alias("_names")).filter(F.col("_names") > block).select(name), "common-keys")
            mine = keys.join(common, name, "left_anti").select("sig", F.col(name).alias("key"))
            some = nodes.join(keys.join(common, name, "left_semi").select("sig").distinct(), "sig", "left_semi")
        used = mine if used is None else used.unionByName(mine)
        if level < levels - 1 and common.isEmpty():
            break
    used = used.distinct()
    a, b = used.select("key", F.col("sig").alias("sig_a")), used.select("key", F.col("sig").alias("sig_b"))
    pairs = a.join(b, "key").filter("sig_a < sig_b").select("sig_a", "sig_b")
    are_open = materialize(nodes.filter("kind = 'latin'").select("sig", "tokens").mapInArrow(_are_open, "sig string"), "open-names")
    if not are_open.isEmpty():
        other = unrefined.select("key", F.col("sig").alias("_other"))
        wide = unrefined.join(are_open, "sig", "left_semi").join(other, "key").filter("sig <> _other")
        pairs = pairs.unionByName(wide.select(F.least("sig", "_other").alias("sig_a"), F.greatest("sig", "_other").alias("sig_b")))
    return pairs.distinct()


def linked_names(names: DataFrame, ratio: float = RATIO, slip: int = 4, block: int = BLOCK) -> DataFrame:
    """name, n (how often it stands) -> name, entity (a signature): distinct strings with the entity that
    they name. Strings that name nobody, and null, empty or invisible strings, are left out; further columns are not
    carried along, repeated rows add up.

    slip: a character counts as a slip where it stands in at most a slip-th of the names of the other, see is_slip."""
    parsed = names.filter("name is not null").groupBy("name").agg(F.sum("n").cast("bigint").alias("n"))
    parsed = materialize(parsed.mapInArrow(_parsed, _NODE), "names")
    nodes = materialize(parsed.groupBy("sig").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.sum("n").alias("n")), "nodes")
    side = lambda s: nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in nodes.columns))
    pairs = candidate_pairs(nodes, block).join(side("a"), "sig_a").join(side("b"), "sig_b")
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("sig_a", "kind_a", "tokens_a", "n_a", "sig_b", "kind_b", "tokens_b", "n_b").repartition(parts, "sig_a", "sig_b").mapInArrow(_compared(ratio), _PAIR)
    pairs = materialize(pairs, "compared")
    short = pairs.filter("how <> 'same'").select(
        F.when(F.col("how") == "a", F.col("sig_a")).otherwise(F.col("sig_b")).alias("short"), F.when(F.col("how") == "a", F.col("sig_b")).otherwise(F.col("sig_a")).alias("long"),
        F.when(F.col("how") == "a", F.col("n_b")).otherwise(F.col("n_a")).alias("n"), "score",
    )
    # of a chain of short forms the longest name counts: what is itself short is no full name, if a full one fits too
    ends = short.join(short.select(F.col("short").alias("long")).distinct().withColumn("_inner", F.lit(True)), "long", "left")
    rank = F.struct(F.col("_inner").isNull(), "score", "n", "long")
    best = materialize(ends.groupBy("short").agg(F.max_by("long", rank).alias("long")), "short-forms")
    # how many full names of organisations have a character in their stem: a row a code point at most
    full = nodes.filter("kind = 'org'").select("sig", F.col("tokens")[0].alias("stem")).join(best.select(F.col("short").alias("sig")), "sig", "left_anti")
    usual = full.select("sig", F.explode(F.array_distinct(F.split("stem", ""))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("support"))
    same = pairs.filter("how = 'same'")
    plain = same.filter("char_a = ''").select("sig_a", "sig_b")
    # a short form joins its full name only; by a substitution it may well be another name's
    swapped = same.filter("char_a <> ''")
    for s in "ab":
        swapped = swapped.join(best.select(F.col("short").alias(f"sig_{s}")), f"sig_{s}", "left_anti")
        swapped = swapped.join(usual.select(F.col("char").alias(f"char_{s}"), F.col("support").alias(f"support_{s}")), f"char_{s}", "left").fillna(0, [f"support_{s}"])
    swapped = swapped.select("*", F.least("char_a", "char_b").alias("first"), F.greatest("char_a", "char_b").alias("last"))
    swapped = materialize(swapped, "swapped")
    both = swapped.groupBy("first", "last").agg(F.count(F.lit(1)).alias("together"))
    slips = swapped.join(both, ["first", "last"]).filter(is_slip(slip)).select("sig_a", "sig_b")
    edges = materialize(plain.unionByName(slips).unionByName(best.select(F.col("short").alias("sig_a"), F.col("long").alias("sig_b"))), "links")
    found = components(edges, "sig_a", "sig_b").select(F.col("node").alias("sig"), "component")
    return parsed.join(found, "sig", "left").select("name", F.coalesce("component", "sig").alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """name, entity -> name_a, name_b: pairs of different strings for one entity, smaller first. The pairs are as many as
    the asked-for result; for use elsewhere the entities themselves are enough."""
    a, b = (linked.select("entity", F.col("name").alias(f"name_{s}")) for s in "ab")
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
