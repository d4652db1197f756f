"""A scorer that needs no model: scores grow with the number of lexicon terms in a row.

It answers a batch prompt with the JSON a language model would return, as a column
expression, so scoring jobs can run and be checked without leaving the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.text import bind
from commentmill.operators.profanity import found_terms


#: Letters that a pattern without case takes for i, s or k though ``lower`` does not make them so.
FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def row_answer(row_id: Column, hits: Column) -> Column:
    """One JSON object for a row with ``hits`` distinct terms."""

    def capped(per_hit: int) -> Column:
        return F.least(F.lit(100), hits * per_hit)

    six = dict.fromkeys(lex.SCORE_FIELDS, F.lit(0))
    six |= {"toxicity": capped(30), "severe_toxicity": capped(10), "insult": capped(35)}
    level = F.get(F.array(*map(F.lit, lex.LEVELS)), F.least(hits, F.lit(3)))
    return F.to_json(F.struct(
        row_id.alias("row_id"), capped(35).alias("overall_score"),
        F.struct(*[v.alias(k) for k, v in six.items()]).alias("scores"),
        F.array(F.when(hits > 0, "Harassment").otherwise("None")).alias("category"),
        level.alias("toxicity_level"),
        F.when(hits > 0, F.array(F.lit("Insult"))).otherwise(
            F.array().cast("array<string>")).alias("toxicity_type")))


def lexicon_scorer(terms: Iterable[str] | None = None, prompt: str = "prompt") -> Column:
    """The answer to a prompt made of ``id: text`` lines."""

    def answer(line: Column) -> Column:
        row_id = F.regexp_extract(line, r"\A(\d+): ", 1).cast("bigint")
        return bind(F.size(found_terms(F.regexp_replace(line, r"\A\d+: ", ""), terms)),
                    lambda hits: row_answer(row_id, hits))

    return F.concat(F.lit("["), F.array_join(
        F.transform(F.split(F.col(prompt), "\n"), answer), ","), F.lit("]"))


def python_scorer(terms: Iterable[str]) -> Callable[[], Callable[[str], str]]:
    """The same answers from a Python function, as a model's client would give them. Rows whose id
    ends in 7 get a score that is not whole, which no retry mends."""
    words, endings = list(terms), list(lex.PROFANITY_SUFFIXES)

    def factory() -> Callable[[str], str]:
        spelled = re.compile(rf"(?i)(?<!\w)({'|'.join(map(re.escape, words))})(?:{'|'.join(endings)})?(?!\w)")
        plain = str.maketrans(lex.LOOKALIKE_FROM, lex.LOOKALIKE_TO)

        # a pattern runs only where a word stands; letters that it takes for others are always searched
        simple = all(re.fullmatch("[a-z0-9]+", w) for w in words)

        def hits(text: str) -> int:
            low = text.lower()
            spelt = low.translate(plain)
            found: set[str] = set()
            if not simple or any(w in low for w in words) or (not text.isascii() and FOLDED.search(text)):
                found |= {m.lower() for m in spelled.findall(text)}
            if not simple or any(w in spelt for w in words):
                found |= set(spelled.findall(re.sub("[^a-z0-9]+", " ", spelt)))
            return len(found)

        def one(line: str) -> dict:
            number, _, text = line.partition(": ")
            n = hits(text)
            six = dict.fromkeys(lex.SCORE_FIELDS, 0) | {
                "toxicity": min(100, 30 * n), "severe_toxicity": min(100, 10 * n), "insult": min(100, 35 * n)}
            return {"row_id": int(number), "overall_score": 12.5 if number.endswith("7") else min(100, 35 * n),
                    "scores": six, "category": ["Harassment" if n else "None"],
                    "toxicity_level": lex.LEVELS[min(n, 3)], "toxicity_type": ["Insult"] if n else []}

        return lambda prompt: json.dumps([one(line) for line in prompt.split("\n")])

    return factory
