"""Thousands of glob rules in one pass over a path: an automaton finds the rules whose literal parts occur, in all at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's $ also stands before one line end at the end of the text.
END = r"(?=(?:\r\n|[\n\r\u0085  ])?\Z)"


def literal_of(glob: str) -> tuple[str, bool]:
    """The longest text that whatever fits the glob holds, and whether it stands at the start; '' if there is none."""
    found, i, start = [("", False)], 0, 0
    while i <= len(glob):
        c = glob[i : i + 1]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else 0
        if c in ("", "*", "?") or end > 0:
            found.append((glob[start:i], start == 0))
            i = start = max(end, i) + 1
        else:
            i += 1
    return max(found, key=lambda x: len(x[0]))


def first_value(text: Column, rules: Mapping[str, str], pattern_of) -> Column:
    """The value of the first rule whose glob fits the text, null for none and for a null text.

    pattern_of gives a glob's regular expression. One automaton holds every rule's longest literal part; only rules whose
    part occurs, and those that have none, are tried by their expressions, in their order. The rules travel with the plan,
    as a configuration does; texts are worked off in batches.
    """
    held = [(*literal_of(g), pattern_of(g).removesuffix("$") + END, value) for g, value in rules.items()]

    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, open_rules, compiled = ahocorasick.Automaton(), [], {}
        by_text: dict[str, list[int]] = {}
        for n, (part, *_) in enumerate(held):
            by_text.setdefault(part, []).append(n) if part else open_rules.append(n)
        for part, numbers in by_text.items():
            automaton.add_word(part, (len(part), numbers))
        automaton.make_automaton()

        def fits(n: int, text: str) -> bool:
            if n not in compiled:
                compiled[n] = re.compile(held[n][2])
            return compiled[n].match(text) is not None

        def first(text: str | None) -> str | None:
            if text is None:
                return None
            likely = set(open_rules)
            for end, (size, numbers) in automaton.iter(text) if by_text else ():
                likely.update(n for n in numbers if not held[n][1] or end + 1 == size)
            return next((held[n][3] for n in sorted(likely) if fits(n, text)), None)

        for batch in batches:
            yield pd.Series([first(t) for t in batch], dtype=object)

    values.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(values, "string")(text)
