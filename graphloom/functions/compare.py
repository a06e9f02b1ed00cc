"""String comparison and chunking that expressions can't state: Arrow batches through plain Python."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import contained_score, plain_answer

SENTENCE = re.compile(r"(?<=[.!?])\s+")


# --- ratios -----------------------------------------------------------------------------------------------------


def common_subsequence(a: str | list, b: str | list) -> int:
    """Length of the longest common subsequence; one row of the table at a time, as bits."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        u = s & where.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of characters in the longest common subsequence, 0 to 100."""
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def subsequence_ends(a: str, b: str) -> np.ndarray:
    """For each place j of b a number e, so that a piece b[l:r] has as many characters outside its longest common subsequence with a as there are j < r with e[j] >= l.

    Strands run through the table of a and b (semi-local combing): they part where characters are equal and cross once at most elsewhere. A step is a diagonal of the table.
    """
    m, n = len(a), len(b)
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a[::-1], b))
    across, down = np.arange(-m, 0, dtype=np.int32), np.arange(n, dtype=np.int32)
    for d in range(m + n - 1):
        first, last = max(0, m - 1 - d), min(m, m + n - 1 - d)
        left, top = across[first:last], down[first + d - m + 1 : last + d - m + 1]
        equal = x[first:last] == y[first + d - m + 1 : last + d - m + 1]
        low, high = np.minimum(left, top), np.maximum(left, top)
        np.copyto(low, top, where=equal)
        np.copyto(high, left, where=equal)
        left[:], top[:] = low, high
    return down


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a piece of the longer one of at most its length.

    One table of both strings has the common subsequences of all pieces.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, ends = len(a), subsequence_ends(a, b)
    at = np.arange(1 - n, len(b))
    first, last = np.maximum(0, at), np.minimum(len(b), at + n)
    # Of the ends before a piece's own end, those from places before its beginning don't count: each from where both lie behind.
    here = np.flatnonzero(ends >= 0)
    counted = np.concatenate([[0], np.cumsum(ends >= 0)])[last]
    past = np.cumsum(np.bincount(np.maximum(ends[here] + 1, here - n + 1), minlength=len(b) + 1))[first]
    size = last - first
    return float((200.0 * (size - counted + past) / (n + size)).max())


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of the sets of words: 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not p or not q):
        return 100.0
    left, right = " ".join([*both, *p]), " ".join([*both, *q])
    base = " ".join(both)
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(base, left), ratio(base, right)]
    return max(scores)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([max(partial_ratio(x or "", y or ""), token_set_ratio(x or "", y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_scored(rows: DataFrame, answer: str, gold: str, name: str = "score") -> DataFrame:
    """Adds a score from 0 to 100: containment where that decides, else the better ratio of the plain forms; only rows that containment leaves open reach Python, dealt to all cores: they are few bytes and much work."""
    known = rows.withColumn(name, contained_score(answer, gold))
    open_ = known.filter(F.col(name).isNull()).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).withColumn(name, fuzzy_ratio(plain_answer(answer), plain_answer(gold)))
    return known.filter(F.col(name).isNotNull()).unionByName(open_)


# --- ROUGE ------------------------------------------------------------------------------------------------------

VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(s: str) -> int:
    return len(re.findall(r"v+c+", "".join("v" if VOWEL.match(s, i) else "c" for i in range(len(s)))))


def _has_vowel(s: str) -> bool:
    return any(VOWEL.match(s, i) for i in range(len(s)))


def _short(s: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", s))


# Endings and what they become, of the second, third and fourth step of the published stemmer.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and _has_vowel(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (STEP2, STEP3):
        for end, to in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted((*STEP4, "ion"), key=lambda e: -len(e)):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def rouge_words(x: str) -> list[str]:
    return [porter_stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", x.lower())]


def rouge_l(answer: str, gold: str) -> float:
    """F-measure of the longest common subsequence of stemmed words; 0 where either is blank."""
    a, g = rouge_words(answer), rouge_words(gold)
    k = common_subsequence(a, g)
    return 2.0 * k / (len(a) + len(g)) if k else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


# --- chunks -----------------------------------------------------------------------------------------------------


def paragraphs(text: str, least: int) -> list[str]:
    """Lines packed to paragraphs of at least `least` words.

    Lines fall into groups: a group begins with a line that has words and ends with the line that brings it to `least` words. A group is a
    paragraph. As long as it is too short, all that it has also ends the paragraph before, anew with every line. The last group may stay too
    short: it is a paragraph only if it is the first one, too.
    """
    lines = [x.strip() for x in text.split("\n")]
    words = [0, *accumulate(len(x.split()) for x in lines)]
    out: list[str] = []
    first = bisect_right(words, 0) - 1
    while first < len(lines):
        last = max(first, bisect_left(words, words[first] + least) - 1)
        grown = ["\n".join(lines[first : i + 1]) for i in range(first, min(last + 1, len(lines)))]
        whole = last < len(lines)
        if out:
            out[-1] = "\n".join([out[-1], *(grown[:-1] if whole else grown)])
        if whole or not out:
            out.append(grown[-1])
        first = bisect_right(words, words[min(last + 1, len(lines))]) - 1
    return out


def sentence_windows(paragraph: str, most: int, overlap: int, faithful: bool) -> list[str]:
    """Sentences in chunks of under `most` words that overlap by about `overlap`. faithful: as the published behaviour has it, the sentence that doesn't fit is lost at a break, and so is a tail no longer than the overlap.

    A chunk is a range of the sentences taken so far; prefix sums of their words tell its length, and where the shortest end of `overlap` words begins.
    """
    if len(paragraph.split()) <= most:
        return [paragraph]
    taken: list[str] = []
    words, out, start, fresh = [0], [], 0, 0
    for s in SENTENCE.split(paragraph):
        n = len(s.split())
        if words[-1] - words[start] + n >= most:
            if faithful or start < len(taken):
                out.append(" ".join(taken[start:]))
            start, fresh = max(start, bisect_right(words, words[-1] - overlap) - 1), len(taken)
            if faithful:
                continue
            if words[-1] - words[start] + n >= most:
                start = fresh
        taken.append(s)
        words.append(words[-1] + n)
    if words[-1] > words[fresh]:
        out.append(" ".join(taken[start:]))
    return out


def chunks_of(text: str, least: int = 150, most: int = 300, overlap: int = 50, faithful: bool = True) -> list[str]:
    return [c for p in paragraphs(text, least) for c in sentence_windows(p, most, overlap, faithful)]


def chunk_udf(least: int = 150, most: int = 300, overlap: int = 50, faithful: bool = True):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[c.strip() for c in chunks_of(t or "", least, most, overlap, faithful)] for t in texts])

    return run


__all__ = ["chunk_udf", "chunks_of", "common_subsequence", "fuzzy_ratio", "fuzzy_scored", "partial_ratio", "porter_stem", "ratio", "rouge_l", "rouge_l_udf", "token_set_ratio"]
