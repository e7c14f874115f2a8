"""What a text must hold for a rule to match: one Aho-Corasick pass decides which rules are tried.

The literals come from the parsed pattern, in lower case, and are looked for in the lower-cased text; where there is
none, a digit may have to be there. A rule that needs neither is always tried. So the filter can't lose a match.
"""

from __future__ import annotations

import re
from re import _constants as k  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

LEAST = 3
MOST = 64
#: Stands for any digit among the literals.
DIGIT = "\0digit"

# Letters that match an ASCII letter when case is ignored, and that one.
FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})


_ANY_DIGIT = re.compile(r"\d")


def fold(text: str) -> str:
    """Lower case, so that whatever matches a literal, with or without case, holds it."""
    return text.lower() if text.isascii() else text.translate(FOLDED).lower()


def _telling(literal: str) -> bool:
    """True for literals that are rare enough to look for: three characters, or one that prose seldom has."""
    return len(literal) >= LEAST or any(not c.isalnum() and c not in " .,-'\"" for c in literal)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The one whose shortest literal is longer; a digit is the least."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (DIGIT not in s, min(map(len, s)), -len(s)))


def _digits_only(items) -> bool:  # noqa: ANN001
    return all((op is k.CATEGORY and arg is k.CATEGORY_DIGIT) or (op is k.RANGE and 48 <= arg[0] and arg[1] <= 57) or (op is k.LITERAL and 48 <= arg <= 57) for op, arg in items)


def _needed(items) -> set[str] | None:  # noqa: ANN001
    """Literals of which any match of a sequence holds one; None if there are no such."""
    best: set[str] | None = None
    run = ""

    def close() -> None:
        nonlocal best, run
        if run and _telling(run):
            best = _better(best, {run})
        run = ""

    for op, arg in items:
        if op is k.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        inner = None
        if op is k.SUBPATTERN:
            inner = _needed(arg[3])
        elif op is k.BRANCH:
            every = [_needed(b) for b in arg[1]]
            if all(e is not None for e in every):
                inner = set().union(*every)
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _needed(arg[2])
        elif op is k.ATOMIC_GROUP:
            inner = _needed(arg)
        elif op is k.IN and _digits_only(arg):
            inner = {DIGIT}
        elif op is k.AT:
            continue  # takes no room
        close()
        if inner is not None and len(inner) <= MOST:
            best = _better(best, inner)
    close()
    return best


def literals(pattern: str) -> set[str] | None:
    """Lower-case literals (or DIGIT), one of which any text that ``pattern`` (for ``re``) matches must hold; None if it need hold none."""
    return _needed(_parser.parse(pattern))


class Prefilter:
    """Which of the patterns may match a text."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.always: list[int] = []
        self.digit: list[int] = []
        self.automaton = ahocorasick.Automaton()
        wanted: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            needed = literals(p)
            if needed is None:
                self.always.append(i)
            else:
                if DIGIT in needed:
                    self.digit.append(i)
                for text in needed - {DIGIT}:
                    wanted.setdefault(text, []).append(i)
        for text, rules in wanted.items():
            self.automaton.add_word(text, tuple(rules))
        self.some = bool(wanted)
        if self.some:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if self.digit and _ANY_DIGIT.search(text):
            found.update(self.digit)
        if self.some:
            for _, rules in self.automaton.iter(fold(text)):
                found.update(rules)
        return sorted(found)
