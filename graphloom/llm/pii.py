"""Personal data with a skip-chain conditional random field.

Patterns give the base spans: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. They stay whatever the
model says. What the patterns can't see is a value written another way: a phone number without its
country code, a card number with odd separators, an address spelled with "at". The model labels candidates: the base spans and all other
digit groups and address-like tokens of the text. A candidate's own potential comes from a logistic regression over its shape; neighbours in
reading order share transition potentials (the chain); candidates of the same or a similar value, however far apart, share agreement potentials (the skip
edges), graded by how similar they are. Similar are numbers of up to 15 digits of which one ends with the other, trunk zeros dropped, by SUFFIX digits at least. A candidate has
skip edges to the last similar one of each length before it and to the base spans next to it on both sides, so that they grow with the candidates. Loopy sum-product message passing
runs ROUNDS rounds with damping; base spans are clamped. A candidate whose marginal for a kind reaches `sure` becomes a span of the method.

Potentials are learned from a sample of about `most_docs` documents (the bound; whole texts, one of each id and text): base spans have their kinds; other candidates have
none, but for those with a skip edge to a base span, which are not labelled. What the patterns can't see is not in their decisions: so every base span is also
written another way (rewritten), which gives the grades of agreement their pairs of one value and one kind. The counts begin with PRIOR such pairs a grade, and the shapes with one made-up
unlabelled example each. The marginals alone decide, in documents without base spans too.

Everything stays within the row; whole texts; offsets are code points.

Defined results: null and empty text have no spans; repeated rows are searched each on their own; input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.learn import fit_logistic

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 12
DAMPING = 0.3
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A group of digits is only tried from its first digit, and never in part: no other start or length can match.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
DIGITS = re.compile(r"\(?[0-9](?:[\x20().-]{0,3}[0-9])+")
SPELLED = re.compile(r"([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})[\x20]?[\[(]?[\x20]?(?:@|\bat\b)[\x20]?[\])]?[\x20]?([A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?[\[(]?dot[\])]?[\x20]?)[A-Za-z0-9-]{1,63}){1,8})", re.IGNORECASE)
FULL = re.compile(r"[0-9]")
# Whatever SPELLED finds has this in it, which is much cheaper to look for.
SPELLED_CORE = re.compile(r"(?:@|\bat\b)[\x20]?[\])]?[\x20]?[A-Za-z0-9-]{1,63}(?:\.|[\x20]?[\[(]?dot[\])]?[\x20]?)[A-Za-z0-9-]", re.IGNORECASE)
HANDLE = re.compile(r"\s@\S")
MOST_AGAINST = 3.0
"""Log odds by which a shape speaks against a kind, at most."""
SUFFIX = 7
"""Digits that similar numbers share at least."""
GRADES = ("same", "long", "short")
"""Of skip edges: the same value; a number that ends another one with LONG digits at least; one with fewer."""
LONG = 10
PRIOR = {"same": 400, "long": 200, "short": 150}
"""Pairs of one value that agreed, before any text is seen."""
PLAIN = ("1234567", "123-4567", "1234567890", "(123) 456-7890", "1.555.123.4567", "12345678901234", "1234 5678 9012 345", "12345678901234567890", "a at b.c", "a @b.c")
"""An unlabelled example of each shape."""


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def _is_ip(s: str) -> bool:
    return IP.fullmatch(s) is not None and all(map(_small, s.split(".")))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one try an @: the run of local characters before it, not before the last match's end, then the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        if at >= free:
            start = at
            while start > free and LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                yield start, m.end()
                free = m.end()
            else:
                # No earlier start can match over this @: the local run doesn't cross it.
                free = max(free, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, in order."""
    if not SIGN.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not FULL.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


@dataclass
class Candidate:
    start: int
    end: int
    kind: int  # of the base span, or -1
    key: str
    shape: tuple[float, ...]


def _shape(s: str) -> tuple[float, ...]:
    n = sum(c in "0123456789" for c in s)
    return (
        float("@" in s and not HANDLE.search(s)), float(n == 0), float(1 <= n <= 6), float(7 <= n <= 9), float(10 <= n <= 13), float(14 <= n <= 19), float(n > 19),
        float(s.startswith("+")), float(_is_ip(s)), float("(" in s), float(any(c in " -." for c in s)), float(14 <= n <= 19 and luhn("".join(c for c in s if c in "0123456789"))),
    )


def _key(s: str) -> str:
    if any(c.isalpha() for c in s):
        s = re.sub(r"[\s\[\]()]*(?:@|\bat\b)[\s\[\]()]*", "@", s.casefold(), count=1)
        return re.sub(r"[\s\[\]()]*\bdot\b[\s\[\]()]*", ".", s)
    return "".join(c for c in s.replace("(0)", "") if c in "0123456789")


def _number(c: Candidate) -> str:
    """The number without trunk zeros if it may be a phone number's, else nothing."""
    d = c.key.lstrip("0") if c.kind in (-1, KINDS.index("phone")) and c.key.isdigit() else ""
    return d if SUFFIX <= len(d) <= 15 else ""


def grade(a: Candidate, b: Candidate) -> str:
    """Of a skip edge."""
    if a.key == b.key:
        return "same"
    return "long" if min(len(_number(a)), len(_number(b))) >= LONG else "short"


def skip_edges(nodes: list[Candidate]) -> list[tuple[int, int]]:
    """Pairs of the same or a similar value."""
    found: set[tuple[int, int]] = set()
    for step in (1, -1):
        # By value, and by each suffix, the last one met; on the way back base spans alone.
        last: dict[tuple, int] = {}
        for i in range(len(nodes))[::step]:
            c, base = nodes[i], nodes[i].kind >= 0
            d = _number(c)
            asked = [("same", c.key), ("ends", d)] + [("is", d[-n:]) for n in range(SUFFIX, len(d))]
            for what, value in asked:
                for kind in (True, False) if step == 1 else (True,):
                    if value and (j := last.get((what, value, kind))) is not None:
                        found.add((min(i, j), max(i, j)))
            if step == 1 or base:
                last["same", c.key, base] = i
                if d:
                    last["is", d, base] = i
                    for n in range(SUFFIX, len(d) + 1):
                        last["ends", d[-n:], base] = i
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    """Base spans, and the other digit groups (7 digits at least) and address-like tokens outside of them, in reading order."""
    taken, last = [], 0
    for s, _, e in base:  # overlapping spans cover one range
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = [Candidate(s, e, k, _key(text[s:e]), _shape(text[s:e])) for s, k, e in base]
    rules = [rule for rule, sign in ((DIGITS, FULL), (SPELLED, SPELLED_CORE)) if sign.search(text)]
    for gap_end, resume in [*taken, (len(text), len(text))]:
        for rule in rules:
            for m in rule.finditer(text, last, gap_end):
                if rule is SPELLED or sum(c in "0123456789" for c in m[0]) >= 7:
                    s, e = m.span()
                    out.append(Candidate(s, e, -1, _key(text[s:e]), _shape(text[s:e])))
        last = resume
    return sorted(out, key=lambda c: (c.start, c.end, c.kind))


@dataclass
class SkipChain:
    """Weights: own (shapes to labels; label 0 is none), chain (label to label), agree (same label over a skip edge, by grade)."""

    own: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    agree: dict[str, float]

    def potentials(self, nodes: list[Candidate]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Of nodes (node, label) and of edges (node, node, labels of both), as logarithms."""
        n, k = len(nodes), len(KINDS) + 1
        unary = np.array([c.shape for c in nodes]) @ self.own + self.bias
        # The patterns call whatever they can't see none: an agreeing base span outweighs that.
        unary = np.maximum(unary, unary[:, :1] - MOST_AGAINST)
        for i, c in enumerate(nodes):
            if c.kind >= 0:
                unary[i] = -50.0
                unary[i, c.kind + 1] = 50.0
        edges = {(i, i + 1): self.chain for i in range(n - 1)}
        for i, j in skip_edges(nodes):
            edges[i, j] = edges.get((i, j), 0.0) + np.eye(k) * self.agree[grade(nodes[i], nodes[j])]
        return unary, [(i, j, w) for (i, j), w in edges.items()]

    def marginals(self, nodes: list[Candidate]) -> np.ndarray:
        """(node, label): sum-product messages, exact where the edges make no loop."""
        k = len(KINDS) + 1
        unary, edges = self.potentials(nodes)
        if not edges:
            p = np.exp(unary - unary.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)
        a = np.array([e[0] for e in edges] + [e[1] for e in edges])
        b = np.array([e[1] for e in edges] + [e[0] for e in edges])
        pot = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        m, half = np.zeros((2 * len(edges), k)), len(edges)
        back = np.concatenate([np.arange(half) + half, np.arange(half)])
        for _ in range(ROUNDS):
            into = unary.copy()
            np.add.at(into, b, m)
            out = (into[a] - m[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            m = DAMPING * m + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        into = unary.copy()
        np.add.at(into, b, m)
        p = np.exp(into - into.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def rewritten(text: str, kind: int) -> list[str]:
    """Other ways to write a base span's value, none of which the patterns see."""
    if KINDS[kind] == "email":
        name, _, host = text.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host}"]
    if KINDS[kind] == "ip":
        return []
    d = "".join(c for c in text if c in "0123456789")
    if KINDS[kind] == "card":
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [f"0{d[n:]}" if n % 2 else d[n:] for n in (1, 2, 3) if len(d) - n >= SUFFIX]


def train(texts: list[str]) -> SkipChain:
    """Potentials of the sample's candidates; without any, shapes say nothing and agreement is that of the prior."""
    k = len(KINDS) + 1
    shapes, labels = [], []
    chain = np.ones((k, k))
    agreed, differed = dict(PRIOR), dict.fromkeys(GRADES, 1)
    for text in texts:
        nodes = candidates(text, base_spans(text))
        edges = skip_edges(nodes)
        unlabelled = {j for e in edges for i, j in (e, e[::-1]) if nodes[i].kind >= 0 > nodes[j].kind}
        for i, c in enumerate(nodes):
            if i in unlabelled:
                continue
            shapes.append(c.shape)
            labels.append(c.kind + 1)
            if i and i - 1 not in unlabelled:
                chain[nodes[i - 1].kind + 1, c.kind + 1] += 1
        for i, j in edges:
            if i not in unlabelled and j not in unlabelled:
                (agreed if nodes[i].kind == nodes[j].kind else differed)[grade(nodes[i], nodes[j])] += 1
        for c in nodes:
            for other in rewritten(text[c.start : c.end], c.kind) if c.kind >= 0 else ():
                pair = [c, Candidate(c.end, c.end + 1, -1, _key(other), _shape(other))]
                if skip_edges(pair):
                    agreed[grade(*pair)] += 1
    width = len(_shape("0"))
    own, bias = np.zeros((width, k)), np.zeros(k)
    if shapes:
        shapes += [_shape(s) for s in PLAIN]
        labels += [0] * len(PLAIN)
        y = np.eye(k)[labels].astype(np.float32)
        own, bias = fit_logistic(np.array(shapes, np.float32), y, l2=1e-3, steps=300, rate=0.1)
    share = chain / chain.sum()
    pmi = np.log(share / np.outer(share.sum(1), share.sum(0)))
    return SkipChain(own.astype(float), bias.astype(float), 0.5 * np.clip(pmi, -1, 1), {g: float(np.log(agreed[g] / differed[g])) for g in GRADES})


def find_spans(text: str, model: SkipChain, sure: float = 0.8) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans of the method)."""
    base = base_spans(text)
    nodes = candidates(text, base)
    if all(c.kind >= 0 for c in nodes):
        return base, []
    p = model.marginals(nodes)
    more = []
    for c, q in zip(nodes, p, strict=True):
        best = int(q[1:].argmax())
        if c.kind < 0 and q[1 + best] >= sure:
            more.append((c.start, best, c.end))
    return base, more


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def fit_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 500) -> SkipChain:
    """Learns from about most_docs documents in which the patterns' characters occur; rows of one id and text are one."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    place = F.pmod(F.xxhash64("id", "text", F.lit("pii")), F.lit(1 << 40)) / float(1 << 40)
    got = rows.filter(place < most_docs / n).groupBy("id", "text").count().collect() if n else []
    return train([r["text"] for r in sorted(got, key=lambda r: (r["id"] is None, r["id"] or "", r["text"]))])


def find_personal_data(docs: DataFrame, model: SkipChain, text_col: str = "text", redact: bool = False) -> DataFrame:
    """Adds pii: array of (start, kind, end, base), in order. redact: the text instead has each span replaced by its kind, <EMAIL> and so on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if redact else docs.drop("pii")
    columns, at = rows.columns, rows.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = rows.schema if redact else T.StructType([*rows.schema.fields, T.StructField("pii", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for x in b.column(at):
                text = x.as_py()
                base, more = find_spans(text or "", m)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                if redact:
                    out.append(redacted(text, spans) if spans else text)
                else:
                    out.append([{"start": s, "kind": KINDS[k], "end": e, "base": o} for s, k, e, o in spans])
            arrays = list(b.columns)
            if redact:
                arrays[at] = pa.array(out, b.column(at).type)
                yield pa.RecordBatch.from_arrays(arrays, columns)
            else:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, kind)], [*columns, "pii"])

    return rows.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Overlapping spans are replaced as one, by the kind of the first."""
    out, last = [], 0
    for s, k, e, _ in spans:
        if s >= last:
            out += [text[last:s], f"<{KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


__all__ = ["SkipChain", "base_spans", "find_personal_data", "find_spans", "fit_spans", "train"]
