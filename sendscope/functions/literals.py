"""Literals that a regex requires, and a prefilter of many regexes by them.

A text can match a regex only if it holds every literal that the regex cannot
do without. Of each regex one such literal gives one key: three characters. A
text's three-character grams meet the keys in one join, whatever the number of
regexes; a regex is tried only on the texts that hold its key and its other
literals.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a key, at least and at most.
KEY, LONG_KEY = 3, 6

_QUOTED = re.compile(r"\\Q(.*?)(?:\\E|$)", re.S)


def _parsed(pattern: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return re._parser.parse(pattern)


def _runs(tree) -> list[str]:
    """Runs of ASCII characters that every match holds, one after another."""
    runs, now = [], ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            now += chr(arg)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            # a boundary takes no characters
            continue
        inner: list[str] = []
        if name == "SUBPATTERN":
            inner = _runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            inner = _runs(arg[2])
        elif name == "ATOMIC_GROUP":
            inner = _runs(arg)
        runs += [now, *inner]
        now = ""
    return [r for r in [*runs, now] if r]


def required_literals(pattern: str) -> list[str]:
    """ASCII literals, folded to lower case, that every match of the regex
    holds. None for a regex that this reader does not know."""
    plain = _QUOTED.sub(lambda m: re.escape(m[1]), pattern).replace(r"\z", r"\Z")
    if "(?x" in pattern or re.search(r"\(\?[a-zA-Z]*x", pattern):
        return []
    try:
        tree = _parsed(plain)
    except (re.error, ValueError, OverflowError, RecursionError):
        return []
    return [r.lower() for r in _runs(tree)]


def choose_keys(patterns: list[str]) -> list[str | None]:
    """For each regex a gram of its required literals, or None if they are all
    too short: of the longest grams (up to LONG_KEY characters) the one that the
    fewest of the regexes share, ties the first in order."""
    found = []
    for p in patterns:
        literals = required_literals(p)
        size = min(max(map(len, literals), default=0), LONG_KEY)
        found.append(sorted({r[i: i + size] for r in literals for i in range(len(r) - size + 1)}) if size >= KEY else [])
    common = Counter(g for some in found for g in some)
    return [min(some, key=lambda g: (common[g], g), default=None) for some in found]


def further_literals(pattern: str, key: str) -> list[str]:
    """The distinct required literals, longest first, that say more than the key."""
    return sorted({r for r in required_literals(pattern) if r not in key}, key=lambda r: (-len(r), r))


def folded(text: Column) -> Column:
    """The text with every character that an ASCII letter matches under Unicode
    case folding as that letter in lower case."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def with_grams(rows: DataFrame, text: str, sizes: list[int], gram: str) -> DataFrame:
    """A row for each distinct gram of the given sizes in the text (none of a
    shorter or null one). The characters are a column of their own, so that no
    gram splits the text again."""
    chars = rows.where(F.length(text) >= min(sizes)).withColumn("_chars", F.split(text, ""))
    starts = F.sequence(F.lit(0), F.size("_chars") - min(sizes))

    def of(n: int) -> Column:
        return F.transform(starts, lambda i: F.array_join(F.slice(F.col("_chars"), i + 1, n), ""))

    every = [of(n) for n in sizes]
    return chars.select(*rows.columns, F.explode(F.array_distinct(F.concat(*every))).alias(gram))
