"""Hooks for models: a call is an Arrow function over batches of prompts, with retries and a result that says how it went.

Models themselves are external. A hook takes any function from prompts to (text, tokens); the deterministic stand-ins below make
every query reproducible.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "text string, tokens long, attempts int, error string"
Call = Callable[[str], tuple[str, int]]


@dataclass(frozen=True)
class Retry:
    """attempts, seconds waited after each (times its number if growing), and what happens when none succeeds: skip, fallback or raise."""

    attempts: int = 10
    wait: float = 0.0
    growing: bool = False
    failure: str = "skip"
    fallback: str | None = None


def call_with_retry(call: Call, prompt: str, retry: Retry, valid: Callable[[str], bool] | None = None) -> tuple[str | None, int, int, str | None]:
    tokens, error = 0, None
    for n in range(1, retry.attempts + 1):
        try:
            text, used = call(prompt)
            tokens += used
            if valid is None or valid(text):
                return text, tokens, n, None
            error = "invalid answer"
        except Exception as e:  # noqa: BLE001  any failure of an external model is retried
            error = f"{type(e).__name__}: {e}"
        if n < retry.attempts and retry.wait:
            time.sleep(retry.wait * (n if retry.growing else 1))
    if retry.failure == "raise":
        raise RuntimeError(f"{retry.attempts} attempts failed: {error}")
    return (retry.fallback if retry.failure == "fallback" else None), tokens, retry.attempts, error


def model_udf(make: Callable[[], Call], retry: Retry = Retry(), valid: Callable[[str], bool] | None = None):  # noqa: B008
    """Column function prompt -> struct(text, tokens, attempts, error). make() builds the client, once a task."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = make()
        for prompts in batches:
            rows = [(None, 0, 0, "no prompt") if p is None else call_with_retry(call, p, retry, valid) for p in prompts]
            yield pd.DataFrame(rows, columns=["text", "tokens", "attempts", "error"])

    return run


def answered(rows: DataFrame, prompt: Column, make: Callable[[], Call], retry: Retry = Retry(), valid: Callable[[str], bool] | None = None, known: Column | None = None) -> DataFrame:  # noqa: B008
    """Adds text, tokens, attempts, error. Where `known` has a value that is the text and the model isn't called: those rows don't reach the function at all."""
    udf = model_udf(make, retry, valid)
    called = rows if known is None else rows.filter(known.isNull())
    out = called.withColumn("_r", udf(prompt)).select("*", "_r.*").drop("_r")
    if known is None:
        return out
    rest = rows.filter(known.isNotNull()).withColumns({"text": known.cast("string"), "tokens": F.lit(0).cast("long"), "attempts": F.lit(0), "error": F.lit(None).cast("string")})
    return out.unionByName(rest)


# --- stand-ins --------------------------------------------------------------------------------------------------

NAME = re.compile(r"[A-Z][a-z]+")


def stand_in_decompose(prompt: str) -> tuple[str, int]:
    """Sentences as units, their capitalised words as entities, neighbours in a sentence as relationships."""
    import json

    units = []
    for s in re.split(r"(?<=[.!?])\s+", prompt):
        names = list(dict.fromkeys(NAME.findall(s)))
        if names:
            units.append({"semantic_unit": s.strip(), "entities": names, "relationships": [f"{a}, with, {b}" for a, b in zip(names, names[1:] or names, strict=False)]})
    return json.dumps(units, ensure_ascii=False), len(prompt.split())


def stand_in_entities(prompt: str) -> tuple[str, int]:
    import json

    return json.dumps(list(dict.fromkeys(NAME.findall(prompt))), ensure_ascii=False), len(prompt.split())


def stand_in_questions(prompt: str, most: int = 4) -> tuple[str, int]:
    import json

    return json.dumps([f"What is {n}?" for n in list(dict.fromkeys(NAME.findall(prompt)))[:most]], ensure_ascii=False), len(prompt.split())


def stand_in_hypothetical(prompt: str) -> tuple[str, int]:
    """Up to ten questions."""
    return stand_in_questions(prompt, 10)


def stand_in_match(prompt: str) -> tuple[str, int]:
    """Names of the last line, a JSON list, in groups by their first letter and length of words, in order."""
    import json

    names = json.loads(prompt.strip().split("\n")[-1])
    groups: dict = {}
    for n in sorted(set(names)):
        groups.setdefault((n[:1].upper(), len(n.split())), []).append(n)
    return json.dumps([groups[k] for k in sorted(groups)], ensure_ascii=False), len(prompt.split())


def stand_in_keywords(prompt: str, least: int = 3, most: int = 50) -> tuple[str, int]:
    """The distinct words of the last line, by their first places; an empty answer if there are too few."""
    import json

    words = list(dict.fromkeys(re.findall(r"[A-Za-z0-9]+", prompt.strip().split("\n")[-1])))[:most]
    return (json.dumps(words) if len(words) >= least else "[]"), len(prompt.split())


def _section(prompt: str, name: str) -> str:
    """What stands under a heading of a prompt, up to the next one."""
    found = re.search(rf"(?:^|\n)\[{name}\]\n(.*?)(?=\n\[[A-Z]+\]\n|\Z)", prompt, re.DOTALL)
    return found[1] if found else ""


def sentences(text: str) -> list[str]:
    """Runs up to a full stop, question or exclamation mark, stripped."""
    found = (re.sub(r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$", "", s) for s in re.findall(r"[^.!?]+[.!?]*", text))
    return [s for s in found if s]


def stand_in_statements(prompt: str) -> tuple[str, int]:
    """The sentences of [TEXT]."""
    import json

    return json.dumps(sentences(_section(prompt, "TEXT")), ensure_ascii=False), len(prompt.split())


def stand_in_correctness(prompt: str) -> tuple[str, int]:
    """Statements of [ANSWER] that [REFERENCE] has, or hasn't, and those that it has alone; all are JSON lists."""
    import json

    mine, theirs = (json.loads(_section(prompt, s) or "[]") for s in ("ANSWER", "REFERENCE"))
    out = {"TP": [x for x in mine if x in theirs], "FP": [x for x in mine if x not in theirs], "FN": [x for x in theirs if x not in mine]}
    return json.dumps(out, ensure_ascii=False), len(prompt.split())


def stand_in_verdicts(prompt: str) -> tuple[str, int]:
    """For each of [STATEMENTS], a JSON list, whether [CONTEXT] holds it, whatever the case."""
    import json

    context = _section(prompt, "CONTEXT").lower()
    return json.dumps([{"statement": s, "verdict": int(s.lower() in context)} for s in json.loads(_section(prompt, "STATEMENTS") or "[]")], ensure_ascii=False), len(prompt.split())


def stand_in_rating(prompt: str) -> tuple[str, int]:
    """2 if [CONTEXT] has all distinct words of [QUESTION], 1 if some, else 0."""
    words = lambda x: {w for w in re.split(r"[^0-9a-z]+", x.lower()) if w}
    q, c = words(_section(prompt, "QUESTION")), words(_section(prompt, "CONTEXT"))
    return f"{2 if q <= c else 1 if q & c else 0} of 2", len(prompt.split())


def stand_in_summary(prompt: str, words: int = 20) -> tuple[str, int]:
    w = prompt.split()
    return " ".join(w[:words]), len(w)


def stand_in_grade(prompt: str) -> tuple[str, int]:
    """1 if the last line occurs in the lines before it."""
    *context, last = prompt.strip().split("\n")
    return str(int(bool(last.strip()) and last.strip().casefold() in "\n".join(context).casefold())), len(prompt.split())


def stand_in_embedding(texts: Column, dims: int = 64) -> Column:
    """Unit vectors of signed word hashes; equal texts have equal vectors."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for t in s:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype("float32").tolist())
        return pd.Series(out)

    return run(texts)


# Prompts, by task; {text} and so on are filled in by prompt().
PROMPTS = {
    "decompose": "Split the passage into semantic units. For each, name the unit, its entities and its relationships, as a JSON list.\n{text}",
    "match": "Put names of the same entity into one group. Answer with a list of lists.\n{text}",
    "attribute": "Summarise what is said of {entity}.\nUnits:\n{units}\nRelationships:\n{relations}",
    "community": "Summarise these passages in one paragraph.\n{text}",
    "overview": "List 3 to 50 keywords of this summary as a JSON list.\n{text}",
    "entities": "List the entities the question asks about as a JSON list.\n{text}",
    "subquestions": "Split the question into at most four simpler ones, as a JSON list.\n{text}",
    "hypothetical": "Write up to ten questions that this passage answers, as a JSON list.\n{text}",
    "answer": "Answer from the contexts alone.\n{contexts}\nQuestion: {text}",
    "reasoned": "Think step by step, then answer from the contexts alone.\n{contexts}\nQuestion: {text}",
    "grade": "Does the answer agree with what is acceptable? Answer 0 or 1.\n{gold}\n{text}",
    "statements": "Break the text up into statements that can be understood alone, as a JSON list.\n[TEXT]\n{text}",
    "correctness": "Sort the statements: TP if the reference supports it, FP if not, FN if only the reference has it. Answer with a JSON object of lists.\n[ANSWER]\n{text}\n[REFERENCE]\n{gold}",
    "attribution_rules": "You decide for every sentence of an answer whether it can be attributed to the context. Decide about one sentence at least.",
    "attribution": "Classify each statement by the context: verdict 1 or 0, as a JSON list of objects.\n[QUESTION]\n{question}\n[CONTEXT]\n{context}\n[STATEMENTS]\n{statements}",
    "facts": "List the facts of the reference that matter for the question, as a JSON list.\n[QUESTION]\n{question}\n[TEXT]\n{text}",
    "fact_coverage": "Say for each fact whether the context covers it: verdict 1 or 0, as a JSON list of objects.\n[CONTEXT]\n{context}\n[STATEMENTS]\n{statements}",
    "faithful_statements": "Take the answer to the question apart into statements without pronouns, as a JSON list.\n[QUESTION]\n{question}\n[TEXT]\n{text}",
    "faithfulness": "Say for each statement whether the context supports it directly: verdict 1 or 0, as a JSON list of objects.\n[CONTEXT]\n{context}\n[STATEMENTS]\n{statements}",
    "relevance": "Rate how far the context helps to answer the question: 0 not at all, 1 partly, 2 fully.\n[QUESTION]\n{question}\n[CONTEXT]\n{context}",
}


def prompt(task: str, **parts: Column) -> Column:
    """The task's prompt with its parts, which are columns, put in."""
    pieces = re.split(r"\{(\w+)\}", PROMPTS[task])
    return F.concat(*[F.coalesce(parts[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
