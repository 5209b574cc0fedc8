"""Tokens, token searches with wildcards, and phrases, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH

#: White space, ASCII punctuation but for the dollar sign, and curly quotes part tokens.
DELIMITERS = "[ \\t\\n\\r\\x0c\\x0b\\u00a0\\ufeff#!\\\\\"%&'()+\\-.,*/:;<=>?@\\[\\]^_`{|}~\\u201c\\u201d\\u2033]+"
_PARTS = set(" \t\n\r\x0c\x0b ﻿#!\\\"%&'()+-.,*/:;<=>?@[]^_`{|}~“”″")


def tokens(text: Column) -> Column:
    """The tokens of a string, in order, case kept."""
    return F.filter(F.split(text, DELIMITERS), lambda t: t != "")


def run_pattern(words: list[str] | tuple[str, ...]) -> str:
    """A regular expression of tokens that follow one another, which finds them in a text that is not parted; no word holds a delimiter."""
    other = "[^" + DELIMITERS[1:-2] + "]"
    # A literal comes first, which a matcher looks for fastest; then, that no token began before it.
    first, *rest = [f"\\Q{w}\\E" for w in words]
    return f"{first}(?<!{other}{first})" + "".join(DELIMITERS + w for w in rest) + f"(?!{other})"


def indexed_tokens(value: Column, is_array: bool, stop_words: frozenset[str] = ENGLISH) -> Column:
    """Tokens but for stop words, which are dropped in exactly their case."""
    found = F.flatten(F.transform(value, lambda s: F.coalesce(tokens(s), F.array().cast("array<string>")))) if is_array else tokens(value)
    return F.array_except(found, F.array(*[F.lit(w) for w in sorted(stop_words)])) if stop_words else F.array_distinct(found)


def split_query(query: str) -> list[str]:
    out, word = [], ""
    for c in query:
        if c in _PARTS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def term_query(query: str) -> tuple[str | None, bool, bool]:
    """The word of a query, None if it has none, and whether a star stands before and after it."""
    start, end = query.startswith("*"), query.endswith("*") and len(query) > 1
    bare = query.strip("*") if start or end else query
    if query == "*" or not bare:
        raise ValueError("a text query needs more than a star")
    words = split_query(bare)
    if len(words) > 1:
        raise ValueError(f"a text query is one word: {query}")
    return words[0] if words else None, start, end


def token_test(word: str, start: bool, end: bool, case_sensitive: bool) -> Callable[[Column], Column]:
    """Whether a token equals the word; with a star before or after it, ends, begins or goes on with it."""
    low = word.lower()
    if start and end:
        return lambda t: F.contains(t, F.lit(word)) | F.contains(F.lower(t), F.lit(word))
    if start:
        return lambda t: F.endswith(t, F.lit(word)) | F.endswith(F.lower(t), F.lit(word))
    if end:
        return lambda t: F.startswith(t, F.lit(word))
    return (lambda t: t == word) if case_sensitive else (lambda t: F.lower(t) == low)


def term_match(value: Column, is_array: bool, query: str, case_sensitive: bool, stop_words: frozenset[str] = ENGLISH) -> Column:
    """Whether a token other than a stop word passes the query's test."""
    word, start, end = term_query(query)
    if word is None or not (start or end) and word in stop_words:
        return F.lit(False)
    test = token_test(word, start, end, case_sensitive)
    stops = F.array(*[F.lit(w) for w in sorted(stop_words)])
    # Few tokens pass the test, so it comes before the look-up of stop words.
    passes = lambda ts: F.exists(ts, lambda t: test(t) & ~F.array_contains(stops, t) if stop_words else test(t))
    if is_array:
        return F.coalesce(F.exists(value, lambda s: F.coalesce(passes(tokens(s)), F.lit(False))), F.lit(False))
    # The raw text holds whatever a token holds: a cheap test before the split.
    held = F.contains(value, F.lit(word))
    if start or not case_sensitive and not end:
        held = held | F.contains(F.lower(value), F.lit(word if start else word.lower()))
    return F.coalesce(held & passes(tokens(value)), F.lit(False))


def phrase_match(text: Column, phrase: str) -> Column:
    """Whether the phrase's tokens follow one another in the text, whatever their case."""
    words = [w.lower() for w in split_query(phrase)]
    if not words:
        return F.lit(False)
    low = F.transform(tokens(F.lower(text)), lambda t: t)
    wanted = F.array(*[F.lit(w) for w in words])
    at = lambda x: F.exists(F.sequence(F.lit(1), F.size(x) - len(words) + 1), lambda i: F.slice(x, i, len(words)) == wanted)
    held = F.get(F.transform(F.array(low), lambda x: F.when(F.size(x) < len(words), F.lit(False)).otherwise(at(x))), F.lit(0))
    return F.contains(F.lower(text), F.lit(words[0])) & F.coalesce(held, F.lit(False))
