"""The full-text query language: words, phrases in quotes, + and -, AND, OR, NOT, parentheses.

Words side by side are alternatives. Words and phrases that may not occur are
tested but not scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import run_pattern, split_query

_LEX = re.compile(r'\s*(?:"([^"]*)"|([()])|([+-])|([^\s()"]+))')


@dataclass(frozen=True)
class Node:
    kind: str  # term, phrase, and, or, not
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def in_text(self, low: Column) -> Column:
        """Whether a lower-cased text matches."""
        if self.kind in ("term", "phrase"):
            return low.rlike(run_pattern(self.words))
        parts = [p.in_text(low) for p in self.parts]
        return ~parts[0] if self.kind == "not" else reduce((lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b), parts)

    def by_places(self, at: dict[str, Column]) -> Column:
        """The same of a row's sorted places of each word."""
        if self.kind == "term":
            return F.size(at[self.words[0]]) > 0
        if self.kind == "phrase":
            # Where each word would have the phrase begin: sets, so a row with many places costs no more than these.
            begins = [F.transform(at[w], _less(i)) if i else at[w] for i, w in enumerate(self.words)]
            return F.size(reduce(F.array_intersect, begins)) > 0
        parts = [p.by_places(at) for p in self.parts]
        return ~parts[0] if self.kind == "not" else reduce((lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b), parts)

    def without_words(self) -> bool:
        """Whether a row that holds none of the words matches."""
        if self.kind in ("term", "phrase"):
            return False
        parts = [p.without_words() for p in self.parts]
        return not parts[0] if self.kind == "not" else all(parts) if self.kind == "and" else any(parts)

    def words_in(self) -> set[str]:
        return set(self.words).union(*[p.words_in() for p in self.parts])

    def scored(self) -> set[str]:
        if self.kind == "not":
            return set()
        return set(self.words).union(*[p.scored() for p in self.parts])


def _less(i: int) -> Callable[[Column], Column]:
    return lambda p: p - i


def _words(text: str) -> Node | None:
    words = [w.lower() for w in split_query(text)]
    if not words:
        return None
    return Node("term", (words[0],)) if len(words) == 1 else Node("phrase", tuple(words))


def phrase(text: str) -> Node:
    return _words(text) or Node("or")


def parse(query: str) -> Node:
    """The tree of a query; a query without words is an `or` of nothing."""
    lexed = []
    at = 0
    while (m := _LEX.match(query, at)) and m.end() > at:
        at = m.end()
        lexed.append(("phrase", m[1]) if m[1] is not None else ("(" if m[2] == "(" else ")", "") if m[2] else ("sign", m[3]) if m[3] else ("word", m[4]))
    if query[at:].strip():
        raise ValueError(f"query can't be read: {query}")
    node, rest = _any(lexed)
    if rest:
        raise ValueError(f"query can't be read: {query}")
    return node or Node("or")


def _any(lexed: list) -> tuple[Node | None, list]:
    """Alternatives, of which some are required or excluded."""
    must: list[Node] = []
    may: list[Node] = []
    while lexed and lexed[0][0] != ")":
        if lexed[0] == ("word", "OR"):
            lexed = lexed[1:]
            continue
        sign = ""
        if lexed[0][0] == "sign":
            sign, lexed = lexed[0][1], lexed[1:]
        node, lexed = _all(lexed)
        if node is None:
            continue
        if sign == "-":
            must.append(Node("not", parts=(node,)))
        elif sign == "+" or node.kind == "not":
            must.append(node)
        else:
            may.append(node)
    if may and not any(n.kind != "not" for n in must):
        must.append(may[0] if len(may) == 1 else Node("or", parts=tuple(may)))
    elif may:
        # Required words decide; the others only add to the score.
        must.append(Node("or", parts=(Node("and", parts=tuple(n for n in must if n.kind != "not")), *may)))
    if not must:
        return None, lexed
    return must[0] if len(must) == 1 else Node("and", parts=tuple(must)), lexed


def _all(lexed: list) -> tuple[Node | None, list]:
    """Operands of AND."""
    node, lexed = _one(lexed)
    parts = [node]
    while lexed and lexed[0] == ("word", "AND"):
        node, lexed = _one(lexed[1:])
        parts.append(node)
    parts = [p for p in parts if p]
    return (None if not parts else parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))), lexed


def _one(lexed: list) -> tuple[Node | None, list]:
    if not lexed:
        raise ValueError("query ends too early")
    kind, value = lexed[0]
    if (kind, value) == ("word", "NOT"):
        node, rest = _one(lexed[1:])
        return (Node("not", parts=(node,)) if node else None), rest
    if kind == "(":
        node, rest = _any(lexed[1:])
        if not rest or rest[0][0] != ")":
            raise ValueError("a parenthesis is not closed")
        return node, rest[1:]
    if kind in ("word", "phrase"):
        return _words(value), lexed[1:]
    raise ValueError(f"query can't be read at {value or kind}")
