"""What a regular expression must find: texts of which every match holds one, in any case.

Patterns are those of Python's ``re`` in any case (IGNORECASE), as rules are written.
"""

from __future__ import annotations

import re
from functools import cache

try:
    from re import _constants as ops
    from re import _parser as parser
except ImportError:  # another Python: no pattern is understood, and each is run on each text
    ops = parser = None


@cache
def _folds() -> list[tuple[str, str]]:
    """(text, what stands for it): small letters that equal another small letter in any case, as they share a capital."""
    shared: dict[str, set[str]] = {}
    for c in map(chr, range(0x20000)):
        low = c.lower()
        if len(low) == 1 and (low != c or c.upper() != c):
            shared.setdefault(c.upper(), set()).add(low)
    return [("i̇", "i")] + sorted((x, min(same)) for same in shared.values() if len(same) > 1 for x in same if x != min(same))


def folded(text: str) -> str:
    """Texts that are equal in any case, as ``re`` has it, become equal."""
    text = text.lower()
    if not text.isascii():
        for a, b in _folds():
            if a in text:
                text = text.replace(a, b)
    return text


def compiles(pattern: str | None) -> bool:
    """Whether a pattern is a regular expression, as it will be run."""
    try:
        re.compile(pattern or "", re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def _required(tokens) -> frozenset[str] | None:
    """Of a parsed sequence: texts of which each match holds at least one; None if there are none such."""
    found: list[frozenset[str]] = []
    run: list[str] = []

    def close():
        if run:
            found.append(frozenset([folded("".join(run))]))
        run.clear()

    def read(sequence):
        for op, value in sequence:
            if op is ops.LITERAL:
                run.append(chr(value))
            elif op is ops.SUBPATTERN:
                read(value[3])
            elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
                continue  # takes no character, so those around it are neighbours
            else:
                close()
                if op is ops.BRANCH:
                    ways = [_required(way) for way in value[1]]
                    if all(ways):
                        found.append(frozenset().union(*ways))
                elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1 and (inner := _required(value[2])):
                    found.append(inner)
                elif op is ops.ATOMIC_GROUP and (inner := _required(value)):
                    found.append(inner)

    read(tokens)
    close()
    return max(found, key=lambda some: (min(map(len, some)), -len(some)), default=None)


def literals(pattern: str) -> frozenset[str] | None:
    """Folded texts of which any text that the pattern matches holds one; None where nothing can be said."""
    if parser is None:
        return None
    return _required(parser.parse(pattern, re.IGNORECASE))


class Matcher:
    """All matches of many patterns: an automaton of their literals says which of them to run on a text."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
        self.always: list[int] = []
        asked: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            some = literals(p)
            if some is None:
                self.always.append(k)
            for text in some or ():
                asked.setdefault(text, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for text, which in asked.items():
            self.automaton.add_word(text, which)
        if asked:
            self.automaton.make_automaton()
        self.some = bool(asked)

    def to_run(self, text: str) -> list[int]:
        """Patterns that may match, in order."""
        if not self.some:
            return self.always
        held = {id(which): which for _, which in self.automaton.iter(folded(text))}
        return sorted({*self.always, *(k for which in held.values() for k in which)})

    def found(self, text: str):
        """(pattern's place, match), by pattern, then by place in the text."""
        for k in self.to_run(text):
            for m in self.compiled[k].finditer(text):
                yield k, m[0]


@cache
def matcher(patterns: tuple[str, ...]) -> Matcher:
    """Of this Python worker, for all its tasks."""
    return Matcher(list(patterns))
