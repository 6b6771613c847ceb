"""Which of many patterns are worth running on a text: one pass of an automaton over the texts that they require.

Every match of most patterns contains one of a few plain texts, its needles.  All needles of a catalogue go into one
Aho-Corasick automaton, which a task builds once and runs once over each text, however many patterns there are; the
patterns it names are then run by Spark's own regex functions, so their syntax is Java's.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LEAST = 2  # characters of a needle


class _Unknown(Exception):
    """A construct that nothing is said about: the pattern has no needles."""


class _Reader:
    """Reads as much of a regex as is needed to name texts of which every match contains one.

    Whatever is not surely understood ends a text, or, where it could change the meaning of what follows, the reading.
    """

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.p[self.at:self.at + n]

    def branches(self) -> list[str] | None:
        """Needles of alternatives up to a closing bracket or the end; None if one of them has none."""
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        return None if None in found else sorted({n for f in found for n in f})

    def sequence(self) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def offer(needles: list[str] | None) -> None:
            nonlocal best
            if needles and min(map(len, needles)) >= LEAST and (best is None or min(map(len, needles)) > min(map(len, best))):
                best = needles

        while self.at < len(self.p) and self.peek() not in "|)":
            c = self.peek()
            if c in "^$":
                self.at += 1
                continue
            if c == "\\" and self.peek(2)[1:] in ("b", "B", "A", "z", "Z", "G"):
                self.at += 2
                continue
            group = None
            if c == "(":
                text, group = None, self.group()
            elif c == "[":
                text = self.klass()
            elif c == "\\":
                text = self.escape()
            elif c == ".":
                text, self.at = None, self.at + 1
            elif c in "?*+{":
                raise _Unknown
            else:
                text, self.at = c, self.at + 1
            least, repeated = self.quantifier()
            if text is None or least == 0:
                offer([run])
                run = ""
                if group and least:
                    offer(group)
            else:
                run += text
                if repeated:  # what follows need not stand right behind the first of several
                    offer([run])
                    run = text
        offer([run])
        return best

    def quantifier(self) -> tuple[int, bool]:
        """(least times, whether it may be more than once)."""
        c = self.peek()
        if c not in ("?", "*", "+", "{"):
            return 1, False
        if c == "{":
            end = self.p.find("}", self.at)
            body = self.p[self.at + 1:end]
            if end < 0 or not body.replace(",", "").isdigit():
                raise _Unknown
            self.at = end
            least = int(body.split(",")[0] or 0)
        else:
            least = 1 if c == "+" else 0
        self.at += 1
        if self.peek() in ("?", "+"):  # lazy or possessive
            self.at += 1
        return least, True

    def group(self) -> list[str] | None:
        self.at += 1
        if self.peek() == "?":
            if self.peek(2) != "?:":  # flags, names, looking around, comments
                raise _Unknown
            self.at += 2
        found = self.branches()
        if self.peek() != ")":
            raise _Unknown
        self.at += 1
        return found

    def klass(self) -> None:
        """A character class, of which nothing is said."""
        end, at = None, self.at + 1
        if self.p[at:at + 1] == "^":
            at += 1
        if self.p[at:at + 1] == "]":
            raise _Unknown
        while at < len(self.p):
            if self.p[at] == "\\":
                if self.p[at + 1:at + 2] == "Q":
                    raise _Unknown
                at += 2
            elif self.p[at] == "[" or self.p[at:at + 2] == "&&":
                raise _Unknown
            elif self.p[at] == "]":
                end = at
                break
            else:
                at += 1
        if end is None:
            raise _Unknown
        self.at = end + 1

    def escape(self) -> str | None:
        c = self.peek(2)[1:]
        self.at += 2
        if c in ("Q", "E", "") or c.isdigit() or c in ("k", "x", "u", "c", "0", "N"):
            raise _Unknown
        if c in ("p", "P"):
            if self.peek() == "{":
                self.at = self.p.index("}", self.at) + 1
            else:
                self.at += 1
            return None
        return c if not c.isalnum() else None


def needles(pattern: str) -> list[str] | None:
    """Texts in lower case of which every match of a (Java) pattern, whatever the case, contains one; None if none are sure."""
    try:
        reader = _Reader(pattern)
        found = reader.branches()
        if reader.at != len(pattern) or found is None:
            return None
    except (_Unknown, ValueError, IndexError):
        return None
    return [n.lower() for n in found] if all(n.isascii() for n in found) else None


_BUILT: dict[str, tuple] = {}


def named_patterns(spark: SparkSession, patterns: list[str]):
    """A function of text columns (in lower case) -> an array with, for each text, the numbers of patterns that may match.

    Patterns without needles are always named.  The needles are sent to every task: a catalogue of 10,000 patterns has
    about a megabyte.  A null text has no patterns.
    """
    wanted: dict[str, list[int]] = {}
    always = []
    for i, p in enumerate(patterns):
        own = needles(p)
        if own is None:
            always.append(i)
        for n in own or []:
            wanted.setdefault(n, []).append(i)
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((wanted, always))

    @F.arrow_udf("array<array<int>>")
    def named(*texts: pa.Array) -> pa.Array:
        if key not in _BUILT:
            import ahocorasick

            words, rest = shared.value
            automaton = ahocorasick.Automaton()
            for n, of in words.items():
                automaton.add_word(n, of)
            if words:
                automaton.make_automaton()
            _BUILT.clear()
            _BUILT[key] = (automaton if words else None, rest)
        automaton, rest = _BUILT[key]
        columns = [t.to_pylist() for t in texts]

        def of(text: str | None) -> list[int]:
            if text is None:
                return []
            found = set(rest)
            if automaton is not None:
                for _, own in automaton.iter(text):
                    found.update(own)
            return sorted(found)

        return pa.array([[of(t) for t in row] for row in zip(*columns)], pa.list_(pa.list_(pa.int32())))

    return named


def constants(values: list[str]) -> Column:
    """An array of texts, of any length, as one literal."""
    mark = "\x1f"
    if any(mark in v for v in values):
        raise ValueError("a pattern with the control character U+001F")
    return F.split(F.lit(mark.join(values)), mark) if values else F.array().cast("array<string>")
