"""A compiled rule set: scans texts and bytes on the executors, compiled once per worker."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from ..functions.entropy import shannon
from ..functions.tokens import keep_jwt
from .dialect import to_python
from .prefilter import Prefilter
from .rules import Rule

FILTERS = {"jwt": keep_jwt}


class Matcher:
    """Hits of a list of rules, rule by rule in order, each from left to right without overlaps of its own."""

    def __init__(self, rules: list[Rule], prefilter: bool = True):
        self.rules = rules
        patterns = [to_python(r.pattern) for r in rules]
        self.text = [re.compile(p) for p in patterns]
        self.bytes: list[re.Pattern | None] = [None] * len(rules)
        self.patterns = patterns
        self.prefilter = Prefilter(patterns) if prefilter else None

    def candidates(self, text: str) -> list[int]:
        return self.prefilter.candidates(text) if self.prefilter else list(range(len(self.rules)))

    def _spans(self, k: int, data: str | bytes) -> Iterator[tuple[int, int]]:
        rule = self.rules[k]
        compiled = self.text[k]
        if isinstance(data, bytes):
            if self.bytes[k] is None:
                self.bytes[k] = re.compile(self.patterns[k].encode())
            compiled = self.bytes[k]
        group = rule.capture_index or 0
        keep = FILTERS.get(rule.filter or "")
        for m in compiled.finditer(data):
            start, end = m.span(group)
            if start < 0:
                continue  # the group took no part
            if rule.min_entropy is not None or keep:
                raw = m[group] if isinstance(data, bytes) else m[group].encode()
                if rule.min_entropy is not None and shannon(raw) < rule.min_entropy:
                    continue
                if keep and not keep(raw.decode("utf-8", "replace")):
                    continue
            yield start, end

    def scan_text(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, byte offset, byte length) of each hit in the text's UTF-8."""
        plain = text.isascii()
        out = []
        for k in self.candidates(text):
            seen = at = 0  # characters before the last hit, and their bytes
            for a, z in self._spans(k, text):
                if plain:
                    out.append((k, a, z - a))
                else:
                    at += len(text[seen:a].encode())
                    seen = a
                    out.append((k, at, len(text[a:z].encode())))
        return out

    def count_text(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, hits, bytes of all its hits) of each rule that hits the text."""
        out = []
        for k in self.candidates(text):
            found = self._found(k, text)
            if found:
                out.append((k, len(found), len("".join(found).encode())))
        return out

    def _found(self, k: int, text: str) -> list[str]:
        """What a rule hits, in one call of the pattern where nothing else decides."""
        rule = self.rules[k]
        group = rule.capture_index or 0
        if rule.min_entropy is None and rule.filter not in FILTERS and self.text[k].groups == group <= 1:
            found = self.text[k].findall(text)
            if not group or "" not in found:  # an empty text may be a group that took no part
                return found
        return [text[a:z] for a, z in self._spans(k, text)]

    def scan_bytes(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, offset, length) of each hit in binary data."""
        return [(k, a, z - a) for k in self.candidates(data.decode("latin-1")) for a, z in self._spans(k, data)]


@lru_cache(maxsize=4)
def compiled(dumped: str, prefilter: bool = True) -> Matcher:
    """The matcher of a dumped rule set (``rules.dump``), one for all tasks of a worker."""
    return Matcher([Rule(**r) for r in json.loads(dumped)], prefilter)
