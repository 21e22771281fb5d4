"""Many patterns at once: each is filed under a literal that its matches must hold, and runs only where that literal stands."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUANTIFIER = re.compile(r"[*?]|\{0?,\d*\}|\{0\}")


def required_literals(pattern: str) -> list[str]:
    """Runs of characters, in lower case, that stand in every match of a regular expression; none where it has alternatives."""
    out, run, depth, i = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if run:
            out.append(run.lower())
        run = ""

    while i < len(pattern):
        c = pattern[i]
        size = 2 if c == "\\" else 1
        literal = pattern[i + 1] if c == "\\" and not pattern[i + 1].isalnum() else c if c not in "\\.^$*+?{}[]()|" else None
        if c == "[":
            size = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(pattern, i).end() - i
        elif c == "{":
            size = pattern.index("}", i) - i + 1
        if c in "()":
            depth += 1 if c == "(" else -1
        if c == "|" and not depth:
            return []
        if literal is None or depth:
            end()
        elif _QUANTIFIER.match(pattern, i + size):  # may be absent
            end()
        else:
            run += literal
        i += size
    end()
    return out


def literal_index(patterns: dict[str, list[str]]) -> list[tuple[str | None, list[str]]]:
    """(literal, patterns filed under it), from (pattern: its required literals); words that most patterns share come first.

    Patterns without a literal are filed under None and always run.
    """
    pieces = {}
    for p, literals in patterns.items():
        words = [re.findall(r"[a-z0-9]+|[^a-z0-9]+", x) for x in literals]
        pieces[p] = {"".join(w[i:j]) for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1) if "".join(w[i:j]).strip()}
    out, left = [], list(patterns)
    while left:
        shared = Counter(x for p in left for x in pieces[p])
        if not shared:
            out.append((None, left))
            break
        best = max(shared, key=lambda x: (shared[x], len(x), x))
        out.append((best, [p for p in left if best in pieces[p]]))
        left = [p for p in left if best not in pieces[p]]
    return out


def where_literal(low: Column, literal: str | None, value: Column, otherwise: Column) -> Column:
    """value where the lower-case text holds the literal."""
    return value if literal is None else F.when(F.contains(low, F.lit(literal)), value).otherwise(otherwise)


def matched(low: Column, index: list[tuple[str | None, list[str]]], test, order: list[str]) -> Column:
    """The patterns that test(pattern) holds for, in order; a text is asked for each literal once, and for the patterns of those that it holds."""
    none = F.array().cast("array<string>")
    groups = [where_literal(low, literal, F.array_compact(F.array(*[F.when(test(p), p) for p in own])), none) for literal, own in index]
    if len(groups) == 1:
        return groups[0]
    found = F.concat(*groups)
    return F.when(F.size(found) < 2, found).otherwise(F.filter(F.array(*map(F.lit, order)), lambda p: F.array_contains(found, p)))
