"""Extraction from claim texts, as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

# Patterns and bounds that decide results stand where they are used, in this module and in lexicon.
HAN = "一-鿿"


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end (trim() knows the plain space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def longest_first(items: Column) -> Column:
    """By falling length; items of one length keep their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("at"), x.alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: s["value"])


def between(items: Column, least: int, most: int) -> Column:
    return F.filter(items, lambda x: F.length(x).between(least, most))


def numbers(text: Column) -> Column:
    """Distinct numbers with their units, longest first, then by code points."""
    all_of = F.array_sort(F.array_distinct(found(text, rf"(?U)[\d.]+\s*(?:{'|'.join(L.UNITS)})")))
    return longest_first(all_of)


def category_pattern(words: Iterable[str] = ()) -> str:
    """Two to thirty ideographs that end with a category word; words of one character don't count."""
    every = {w.strip() for w in (*L.CATEGORY_WORDS, *words) if w and len(w.strip()) >= 2}
    return f"[{HAN}]{{2,30}}{any_of(sorted(every, key=lambda w: (-len(w), w)))}"


def entities(text: Column, pattern: str) -> Column:
    """Distinct names: quoted, in title marks, or with a category suffix; longest first.

    Whatever holds a mark of punctuation is a sentence and not a name."""
    quoted = [found(text, p, 1) for p in ("“([^“”]{2,50})”", '"([^"]{3,50})"', "《([^《》]{2,50})》")]
    names = F.transform(F.concat(*quoted, found(text, pattern)), trimmed)
    return longest_first(F.array_distinct(F.filter(names, lambda x: ~x.rlike("[，、；。！？,;]"))))


def names_something(entity: Column) -> Column:
    """False for pieces of sentences that were taken for a name: blank, with a pronoun or negation, with a
    leading ordinal, conjunction, verb or particle, or long without title marks."""
    starts = "|".join((f"[{L.ORDINALS}][是、]", rf"第[{L.ORDINALS}\d]阶", *L.CONJUNCTIONS, *L.VERB_PREFIXES, f"[{L.PARTICLES}]"))
    noise = entity.rlike(f"(?U)^(?:{starts})") | entity.rlike("|".join((*L.PRONOUNS, "不是"))) | (trimmed(entity) == "")
    return ~(noise | ((F.length(entity) >= 20) & ~entity.rlike(f"[{L.TITLE_MARKS}]")))


def clauses(text: Column, pattern: str) -> Column:
    """Sub-claims: parts between semicolons and commas of at least eight characters, each with what
    can be verified in it."""
    long_enough = lambda parts: F.filter(F.transform(parts, trimmed), lambda x: F.length(x) >= L.CLAUSE_LEAST)
    parts = F.flatten(F.transform(long_enough(F.split(text, "；")), lambda p: long_enough(F.split(p, "，"))))

    def described(part: Column) -> Column:
        n, e = numbers(part), entities(part, pattern)
        independent = (F.size(n) > 0) | (F.size(e) > 0) | part.rlike(any_of(L.CLAUSE_VERBS))
        return F.struct(part.alias("text"), independent.alias("independent"), n.alias("numbers"), e.alias("entities"))

    return F.transform(parts, described)


def keywords(text: Column, whole_numbers: bool = False) -> Column:
    """Up to eight search keys, longest first: quoted names, numbers, verb phrases, the longest runs of
    ideographs; the head of the text if there are none.

    By the original rule digits belong to the first kind of unit only; whole_numbers mends that."""
    pairs = ("“”", "‘’", "「」", "『』", "《》", '""')
    quoted = [found(text, f"{p[0]}([^{p}]{{2,}}){p[1]}", 1) for p in pairs]
    units = "|".join(L.UNITS)
    counted = found(text, rf"(?U)[\d.]+(?:{units})" if whole_numbers else rf"(?U)[\d.]+{units}")
    phrases = found(text, f"{any_of(L.KEYWORD_VERBS)}[{HAN}]{{2,20}}")
    sized = between(F.transform(F.concat(*quoted, counted, phrases), trimmed), L.KEYWORD_LEAST, L.KEYWORD_MOST)
    runs = F.slice(longest_first(found(text, f"[{HAN}]{{4,40}}")), 1, L.RUNS_KEPT)
    keys = F.slice(longest_first(F.array_distinct(F.concat(sized, runs))), 1, L.KEYWORDS_KEPT)
    head = F.when(trimmed(text) != "", F.array(F.substring(text, 1, L.FALLBACK))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(keys) > 0, keys).otherwise(head)


def snippet(text: Column, key: Column, radius: int = L.SNIPPET_RADIUS) -> Column:
    """The surroundings of the first occurrence of key on one line; empty if there is none."""
    at = F.instr(text, key)
    start = F.greatest(at - radius, F.lit(1))
    cut = F.substring(text, start, at + F.length(key) + radius - start)
    return F.when(at > 0, F.replace(cut, F.lit("\n"), F.lit(" "))).otherwise("")


def content_words(text: Column) -> Column:
    """Distinct runs of two to six ideographs, longest first, then by code points."""
    return longest_first(F.array_sort(F.array_distinct(found(text, f"[{HAN}]{{2,6}}"))))


def query_terms(claim: Column, number_list: Column, entity_list: Column) -> Column:
    """Terms to search for: the claim's head, its numbers and names, and the content words that no term
    taken before contains."""
    head = trimmed(F.substring(claim, 1, L.CLAIM_HEAD))
    exact = exact_terms(number_list, entity_list)
    every = content_words(claim)
    # a word within a word that was itself left out is within the term that held that one, so order needs no state
    held = lambda w, i: F.exists(exact, lambda t: F.contains(t, w)) | F.exists(F.slice(every, 1, i), lambda t: F.contains(t, w))
    words = F.filter(every, lambda w, i: ~held(w, i))
    return F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), exact, words)


def exact_terms(number_list: Column, entity_list: Column) -> Column:
    """Numbers and names, trimmed, distinct, longest first."""
    both = F.transform(longest_first(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (number_list, entity_list)))), trimmed)
    return F.array_distinct(F.filter(both, lambda t: t != ""))


def apart(places: Column, width: Column) -> Column:
    """How many of the places (in order) of a string of that width don't overlap, taken from the left; one pass."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))
    step = lambda acc, p: F.when(p >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (p + width).cast("int").alias("free"))).otherwise(acc)
    return F.when(F.size(places) < 2, F.size(places)).otherwise(F.aggregate(places, start, step, lambda acc: acc["n"]))


def attribute_words(text: Column, entity: Column, window: int = L.ATTRIBUTE_WINDOW) -> Column:
    """Runs of three to fifteen ideographs near the first occurrence of entity, less parts of it."""
    at = F.instr(text, entity)
    start = F.greatest(at - window, F.lit(1))
    near = F.substring(text, start, at + F.length(entity) + window - start)
    runs = F.array_distinct(F.filter(found(near, f"[{HAN}]{{3,15}}"), lambda w: ~F.contains(entity, w)))
    return F.when(at > 0, runs).otherwise(F.array().cast("array<string>"))


def normal_status(status: Column) -> Column:
    """confirmed, not_found, partial or other."""
    has = lambda *words: status.rlike("|".join(words))
    return F.when(has("✓", "已确认"), "confirmed").when(has("未找到"), "not_found").when(has("△", "部分", "需核实", "数据不一致"), "partial").otherwise("other")
