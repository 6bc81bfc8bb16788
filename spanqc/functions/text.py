"""Text functions as Columns; Python only for sequence similarity."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .matching import similarity_of


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    """The text, or '' for null."""
    return F.coalesce(column(c).cast("string"), F.lit(""))


def let(result, **columns: Column) -> Column:  # noqa: ANN001
    """``result`` of a struct of columns, each worked out once however often it is used.

    Filters that are pushed below a projection repeat its expressions; a bound variable isn't repeated.
    """
    bound = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return F.get(F.transform(bound, result), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(column(c), r"(?U)^\s+|\s+\z", "")


def word_count(c: Column | str) -> Column:
    """Runs of other than white space; null has none."""
    return F.coalesce(F.regexp_count(column(c), F.lit(r"(?U)\S+")), F.lit(0))


def words_between(c: Column | str, low: int, high: int) -> Column:
    """Whether a text has ``low`` to ``high`` words, by ``word_count``; of a longer text no more is read than that many words."""
    return F.coalesce(F.rlike(column(c), F.lit(rf"(?U)\A\s*+(?:\S++\s*+){{{low},{high}}}+\z")), F.lit(low <= 0))


def collapse(c: Column | str) -> Column:
    """Lower case, white space made one blank, none at the ends; accents stay."""
    return strip(F.regexp_replace(F.lower(or_empty(c)), r"(?U)\s+", " "))


def as_bool(c: Column | str) -> Column:
    """Spellings of truth in any case; anything else, null too, is false."""
    return F.coalesce(F.lower(strip(column(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def bare(ch: str) -> str:
    """A character without its accents, in compatibility form."""
    return "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch)) if unicodedata.category(x) != "Mn")


#: Accented letters whose bare form is one character; a rule makes the table.
ACCENTED = [chr(k) for k in range(0xC0, 0x250) if len(bare(chr(k))) == 1 and bare(chr(k)) != chr(k)]
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}


def tidy(c: Column) -> Column:
    """One blank for white space, none before . , ; : ! ? nor at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)\s+([.,;:!?])", "$1"))


def normalize_fast(c: Column | str) -> Column:
    """Normal form for comparison of precomposed Latin text: no accents, straight quotes, tidy white space."""
    low = F.lower(or_empty(c))
    return tidy(F.translate(low, "".join(ACCENTED) + "".join(QUOTES), "".join(map(bare, ACCENTED)) + "".join(QUOTES.values())))


def normal_form(text: str | None) -> str:
    """The exact normal form: lower case, NFKC, no combining marks, straight quotes, tidy white space."""
    if text is None:
        return ""
    out = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text.lower())) if unicodedata.category(c) != "Mn")
    out = re.sub(r"\s+", " ", out.translate(str.maketrans(QUOTES)))
    return re.sub(r"\s+([.,;:!?])", r"\1", out).strip()


def runs_of(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Numbers in order as runs, first and last."""
    known = set(numbers)
    starts = [k for k in numbers if k - 1 not in known]
    ends = [k for k in numbers if k + 1 not in known]
    return list(zip(starts, ends, strict=True))


#: Syllables that are three letters by arithmetic, and the first of each kind of letter.
HANGUL, LEADS, VOWELS, TAILS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7


@cache
def bare_forms() -> tuple[dict[str, str], dict[str, str]]:
    """For all characters whose bare lower form is another: those with one character or none, and those with more.

    Full decomposition and leaving out marks need no neighbours, so a text's form is that of its characters; only
    the lower form of sigma depends on its place. Syllables of Hangul are left out, as they follow by arithmetic.
    """
    one, more = {}, {}
    for k in range(sys.maxunicode + 1):
        ch = chr(k)
        if 0xD800 <= k <= 0xDFFF or HANGUL[0] <= k <= HANGUL[1] or ch == "\N{GREEK CAPITAL LETTER SIGMA}":
            continue
        form = QUOTES.get(ch) or (" " if ch.isspace() else bare(ch.lower()))
        if form != ch:
            (one if len(form) < 2 else more)[ch] = form
    return one, more


def normalize_exact(c: Column | str) -> Column:
    """The exact normal form, as ``normal_form`` has it."""
    one, more = bare_forms()
    text = or_empty(c)
    text = F.when(F.contains(text, F.lit("Σ")), F.lower(text)).otherwise(text)
    kept = sorted(one, key=lambda ch: one[ch] == "")  # what goes stands last, where it has no counterpart
    single = F.translate(text, "".join(kept), "".join(one[ch] for ch in kept))
    rest = [*runs_of(sorted(map(ord, more))), HANGUL]
    several = "[\\x{80}-\\x{10ffff}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in rest) + "]]"  # hundreds of ranges, not asked for ASCII
    forms = F.str_to_map(F.lit("\x01".join(f"{ch}\x02{form}" for ch, form in more.items())), F.lit("\x01"), F.lit("\x02"))

    def letters(ch: Column) -> Column:
        number = F.ascii(ch) - HANGUL[0]
        of = lambda first, n, at: F.substring(F.lit("".join(chr(first + k) for k in range(n))), at + 1, F.lit(1))
        tail = F.when(number % 28 > 0, of(TAILS, 28, number % 28)).otherwise("")
        return F.concat(of(LEADS, 19, F.floor(number / 588).cast("int")), of(VOWELS, 21, F.floor(number % 588 / 28).cast("int")), tail)

    def form(ch: Column) -> Column:
        return F.when(ch.between(chr(HANGUL[0]), chr(HANGUL[1])), letters(ch)).when(F.rlike(ch, F.lit(several)), F.element_at(forms, ch)).otherwise(ch)

    long = F.array_join(F.transform(F.split(single, ""), form), "")
    return tidy(F.when(F.rlike(single, F.lit(several)), long).otherwise(single))


def normalize(c: Column | str, exact: bool = True) -> Column:
    """The exact normal form, or the fast one for precomposed Latin text."""
    return normalize_exact(c) if exact else normalize_fast(c)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character similarity ratio of two columns; a pair that a batch repeats is worked out once."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    known = {pair: similarity_of(*pair) for pair in set(pairs)}
    return pd.Series([known[pair] for pair in pairs], dtype="float64")


def normalize_answer(c: Column | str) -> Column:
    """Lower case without ASCII punctuation, white space made one blank."""
    plain = F.regexp_replace(F.lower(or_empty(c)), r"[!-/:-@\[-`{-~]", "")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Words of the normalised answer."""
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def count_in(array: Column, value: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two arrays of words as multisets; 0 where either is empty or nothing is shared."""
    shared = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda n, t: n + F.least(count_in(predicted, t), count_in(gold, t)))
    both = F.size(predicted) + F.size(gold)
    return F.when((F.size(predicted) == 0) | (F.size(gold) == 0), F.lit(0.0)).otherwise(2.0 * shared / both)


def exact_match(predicted: Column, gold: Column) -> Column:
    return (predicted == gold).cast("int")


def best_over(golds: Column, score) -> Column:  # noqa: ANN001
    """The best score over several gold texts; 0 with none."""
    return F.coalesce(F.array_max(F.transform(golds, score)), F.lit(0))


def find(haystack: Column | str, needle: Column | str) -> Column:
    """Offset of the first occurrence in code points, -1 if none; a blank needle is nowhere."""
    h, n = column(haystack), column(needle)
    return F.when(strip(or_empty(n)) == "", F.lit(-1)).otherwise(F.coalesce(F.instr(h, n), F.lit(0)) - 1)


def count_overlapping(haystack: Column | str, needle: Column | str) -> Column:
    """Occurrences, overlapping ones too; an empty needle has none."""
    h, n = or_empty(haystack), or_empty(needle)
    first = F.instr(h, n)
    once = F.instr(F.substring(h, first + 1, F.length(h)), n) == 0  # no pattern is compiled for these, which most are
    slow = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(h) - F.length(n) + 1)), lambda i: F.substring(h, i, F.length(n)) == n))
    fast = F.regexp_count(h, F.concat(F.lit(r"(?=\Q"), n, F.lit(r"\E)")))
    return F.when((n == "") | (first == 0), F.lit(0)).when(once, F.lit(1)).when(F.contains(n, F.lit(r"\E")), slow).otherwise(fast)


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern of the longest of the words that stands at a place."""
    tree: dict = {}
    for word in words:
        at = tree
        for ch in word:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(ch) + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return joined + "?" * ("" in node)

    return pattern(tree)


def overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def count_hits(c: Column | str, hints: Sequence[str]) -> Column:
    """Occurrences of all hints, of each without overlap, added up.

    One scan finds the longest hint at every place; those that begin there as well are its beginnings, so that how many
    is known by the longest. Only hints that can overlap themselves are counted one by one.
    """
    text = or_empty(c)
    found = F.lit(0)
    scanned = [h for h in hints if not overlaps_itself(h)]
    if scanned:
        at = F.regexp_extract_all(text, F.lit(f"(?s)(?=({trie_pattern(scanned)}))"), 1)
        depth = {h: sum(h.startswith(x) for x in scanned) for h in scanned}
        deep = lambda at, n: F.size(F.filter(at, lambda h: h.isin(*[w for w in scanned if depth[w] >= n])))
        found = let(lambda x: sum((deep(x["at"], n) for n in range(2, max(depth.values()) + 1)), F.size(x["at"])), at=at)
    for hint in hints:
        if overlaps_itself(hint):
            found = found + ((F.length(text) - F.length(F.replace(text, F.lit(hint), F.lit("")))) / len(hint)).cast("int")
    return found


def any_hint(c: Column | str, hints: Sequence[str]) -> Column:
    """Whether any hint stands in the text, as a part of a word too."""
    text = or_empty(c)
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(text, h)) if hints else F.lit(False)


def window_around(c: Column | str, at: Column, size: Column, margin: int = 120) -> Column:
    """The text around a span, cut off at the ends."""
    first = F.greatest(F.lit(0), at - margin)
    return F.substring(column(c), first + 1, at + size + margin - first)


def starts_at(c: Column | str, part: Column, at: Column) -> Column:
    """Whether a part stands at an offset, which isn't negative."""
    return (at >= 0) & (F.substring(column(c), at + 1, F.length(part)) == part)


def slice_of(c: Column | str, start: Column, end: Column) -> Column:
    """The text between two offsets; empty unless 0 <= start <= end."""
    return F.when((start >= 0) & (end >= start), F.substring(column(c), start + 1, end - start)).otherwise(F.lit(""))


def last_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    """A group of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(group)), F.lit(-1))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def short_id(*parts: Column, digits: int = 8) -> Column:
    """The first hex digits of an MD5."""
    return F.substring(F.md5(F.concat(*[or_empty(p) for p in parts])), 1, digits)


def sanitized(c: Column | str, longest: int = 96) -> Column:
    """A name of letters, digits, dot, dash and underscore; a longer one is cut and ends with a digest."""
    plain = F.regexp_replace(or_empty(c), r"[^A-Za-z0-9._-]+", "_")
    cut = F.concat(F.substring(plain, 1, longest - 9), F.lit("-"), F.substring(F.sha1(column(c)), 1, 8))
    return F.when(F.length(plain) <= longest, plain).otherwise(cut)


def path_part(c: Column | str, from_end: int) -> Column:
    """A folder of a path, counted from the end (1 is the file)."""
    return F.try_element_at(F.filter(F.split(column(c), "[/\\\\]+"), lambda p: p != ""), F.lit(-from_end))


def prompt(context: Column | str, question: Column | str, template: str = "Contexto:\n%s\n\nPregunta:\n%s\n\nRespuesta:") -> Column:
    """The text that a generator is given."""
    return F.format_string(template, or_empty(context), or_empty(question))


ANSWER_JSON = "answer_text string, is_impossible string"


def parse_answer(c: Column | str, schema: str = ANSWER_JSON, fallback: str = "RESPUESTA_NO_ENCONTRADA") -> Column:
    """A generator's JSON answer: code fences are taken off, then the text between the outer braces is tried; else the fallback."""
    raw = or_empty(c)
    bare_text = strip(F.regexp_replace(raw, r"(?i)\A\s*```(?:json)?|```\s*\z", ""))
    inner = F.regexp_extract(bare_text, r"(?s)(\{.*\})", 1)
    whole = F.when(F.try_parse_json(bare_text).isNotNull() & F.startswith(bare_text, F.lit("{")), F.from_json(bare_text, schema))
    part = F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema))
    lost = F.struct(F.lit(fallback).alias("answer_text"), F.lit("imposible").alias("is_impossible"))
    return F.coalesce(whole, part, lost)


@F.pandas_udf(DoubleType())
def google_bleu(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """The lesser of precision and recall over all n-grams of one to four words; two empty texts score 0."""
    from collections import Counter

    def grams(text: str | None) -> Counter:
        words = (text or "").split()
        return Counter(tuple(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))

    def score(a: str | None, b: str | None) -> float:
        x, y = grams(a), grams(b)
        most = max(sum(x.values()), sum(y.values()))
        return sum((x & y).values()) / most if most else 0.0

    return pd.Series([score(a, b) for a, b in zip(predicted, gold, strict=True)])
