"""Regex helpers.

Spark's ``rlike`` is a Java-regex *search* (partial match), like DuckDB's
``regexp_matches``. Java folds case for ASCII only under ``(?i)``; adding the
``u`` flag gives Unicode case folding as in RE2, so ``É`` matches ``é``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The yes/no markers written into keyword flag columns.
FLAG_YES = "sim"
FLAG_NO = "não"

_LEADING_FLAGS = re.compile(r"^\(\?([a-zA-Z]+)\)")


def unicode_case(pattern: str) -> str:
    """Rewrite a leading inline ``(?i…)`` group so case folding is Unicode-aware."""
    m = _LEADING_FLAGS.match(pattern)
    if not m or "i" not in m.group(1) or "u" in m.group(1):
        return pattern
    return f"(?{m.group(1)}u)" + pattern[m.end():]


# Word boundaries on ASCII word characters, as in RE2. Java's own \b also
# counts accented letters as word characters, so "éthe" has no boundary
# before "t" in Java but has one in RE2. Java's \w is ASCII unless (?U).
_ASCII_B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_ASCII_NOT_B = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def ascii_word_boundaries(pattern: str) -> str:
    r"""Rewrite ``\b`` / ``\B`` outside character classes and ``\Q…\E``
    quotes into ASCII word-boundary lookarounds."""
    out, i, depth, n = [], 0, 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "Q":
                end = pattern.find("\\E", i + 2)
                end = n if end < 0 else end + 2
                out.append(pattern[i:end])
                i = end
                continue
            if depth == 0 and nxt in "bB":
                out.append(_ASCII_B if nxt == "b" else _ASCII_NOT_B)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and depth > 0:
            depth -= 1
        out.append(ch)
        i += 1
    return "".join(out)


_CLASSES = {"s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]"}


def re2_classes(pattern: str) -> str:
    r"""Give ``\s``, ``\S`` and ``$`` RE2's meaning: Java's ``\s`` also takes a
    vertical tab, and its ``$`` also matches before a final line break (so it
    becomes ``\z``, unless a ``(?m)`` flag makes it the end of a line).
    Quotes stay as they are, classes nest in classes."""
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    out, i, depth = [], 0, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == "\\Q":
            end = pattern.find("\\E", i + 2)
            end = len(pattern) if end < 0 else end + 2
            out.append(pattern[i:end])
            i = end
            continue
        if two[0] == "\\":
            out.append(_CLASSES.get(two[1:], two))
            i += 2
            continue
        if two[0] == "$" and not depth and not multiline:
            out.append(r"\z")
        else:
            depth += {"[": 1, "]": -1 if depth else 0}.get(two[0], 0)
            out.append(two[0])
        i += 1
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """A Java regex that searches like the same pattern in RE2 (DuckDB)."""
    return unicode_case(ascii_word_boundaries(re2_classes(pattern)))


def matches(col: Column | str, pattern: str) -> Column:
    """Null-safe regex search: a null text never matches (falls to 'no')."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(java_pattern(pattern)), F.lit(False))


def flag(col: Column | str, pattern: str) -> Column:
    """``'sim'`` when the pattern occurs in the text, else ``'não'``."""
    return F.when(matches(col, pattern), F.lit(FLAG_YES)).otherwise(F.lit(FLAG_NO))
