"""Rule patterns are written for an engine without look-around, whose ``$`` and ``\\z`` mean the end of the text. This
module rewrites them for the engines at hand: Python's ``re`` (text or bytes), Java's, and RE2."""

from __future__ import annotations

import re

# What the POSIX classes stand for inside brackets.
POSIX = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
    "space": r" \t\n\r\f\v", "blank": r" \t", "word": r"\w", "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1f\x7f",
    "print": " -~", "graph": "!-~", "ascii": r"\x00-\x7f",
}

_FLAGS = re.compile(r"\(\?([imsx]+)\)")


def _rewrite(pattern: str, end: str, group: str) -> str:
    """One pass over the pattern: classes, ends of text, named groups and flags in mid-pattern."""
    out: list[str] = []
    closers = [0]  # groups opened by flags, by depth of parentheses
    i, in_class, first = 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append(end if two == r"\z" and not in_class else two)
            i, first = i + 2, False
            continue
        if in_class:
            named = re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])
            if named and named[2] in POSIX:
                out.append(POSIX[named[2]])
                i += named.end()
            elif c == "]" and not first:
                out.append(c)
                in_class, i = False, i + 1
            else:
                out.append("\\" + c if c in "[]" or (c == "&" and pattern[i : i + 2] == "&&") else c)
                i += 1
            first = c == "^" and first
            continue
        if c == "[":
            out.append(c)
            in_class = first = True
            i += 1
        elif c == "(":
            flags = _FLAGS.match(pattern, i)
            if flags and i:  # they hold to the end of the group that they stand in
                out.append(f"(?{flags[1]}:")
                closers[-1] += 1
                i = flags.end()
                continue
            name = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if name:
                out.append(group.replace("NAME", name[1] if "?P" in group else name[1].replace("_", "U")))
                i += name.end()
            else:
                out.append(c)
                i += 1
            closers.append(0)
        elif c == ")":
            out.append(")" * (closers.pop() if len(closers) > 1 else 0) + ")")
            i += 1
        elif c == "|" and closers[-1]:  # flags reach over alternatives
            out.append(")" * closers[-1] + "|" + "".join(_reopen(out, closers[-1])))
            i += 1
        elif c == "$":
            out.append(end)
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out) + ")" * closers[0]


def _reopen(out: list[str], n: int) -> list[str]:
    return [x for x in out if re.fullmatch(r"\(\?[imsx]+:", x)][-n:]


def to_python(pattern: str) -> str:
    """For ``re``, on text or, encoded, on bytes."""
    return _rewrite(pattern, r"\Z", "(?P<NAME>")


def to_java(pattern: str) -> str:
    """For Spark's functions; the dot excludes line feeds alone."""
    return "(?d)" + _rewrite(pattern, r"\z", "(?<NAME>")


def to_re2(pattern: str) -> str:
    """For DuckDB, which takes the patterns as they are but for ``$``."""
    return _rewrite(pattern, r"\z", "(?P<NAME>")


def portable(pattern: str) -> bool:
    """False for patterns with look-around or back references, which the rule language hasn't."""
    bare = re.sub(r"\\\\", "", pattern)
    return re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", bare) is None
