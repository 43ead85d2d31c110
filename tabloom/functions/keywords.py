"""First keyword, in rule order, that a text contains: all keywords in one pass over the text.

The keywords become one Aho-Corasick automaton, built once for each Python worker.  A text is read once, whatever the number of
keywords, and occurrences may overlap.  Texts reach the automaton as Arrow batches; one number a text comes back.  A
regular expression of all keywords stays in the JVM but tries its branches at every character: 11 s where this takes 2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Answer of the first rule whose keyword is part of the text, else ``default``; null text holds no keyword.

    An empty keyword is part of every text.
    """
    always = next((i for i, (k, _) in enumerate(rules) if not k), len(rules))
    last = rules[always][1] if always < len(rules) else default
    first: dict[str, int] = {}
    for i, (k, _) in enumerate(rules[:always]):
        first.setdefault(k, i)
    if not first:
        return F.lit(last)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for keyword, i in first.items():
            automaton.add_word(keyword, i)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([min((i for _, i in automaton.iter(t)), default=-1) if t else -1 for t in batch], dtype="int32")

    found = F.pandas_udf(run, "int")(text)
    answers = F.array(*[F.lit(a) for _, a in rules[:always]])
    return F.when(found >= 0, F.get(answers, found)).otherwise(last)
