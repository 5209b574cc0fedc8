"""Operations on single documents as Python dicts, as they are before a write and after a read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

RESERVED = ("_id", "_revision", "_source", "_modified")


def get(document: dict[str, Any], path: str, separator: str = ".") -> Any:
    """The value at a path; None if there is none. A whole key with the separator in it wins over descent."""
    if path in document:
        return document[path]
    at: Any = document
    for step in path.split(separator):
        if not isinstance(at, dict) or step not in at:
            return None
        at = at[step]
    return at


def put(document: dict[str, Any], path: str, value: Any, separator: str = ".") -> None:
    """Set a value, making the documents on its way."""
    *outer, last = path.split(separator)
    for step in outer:
        inner = document.get(step)
        if not isinstance(inner, dict):
            inner = document[step] = {}
        document = inner
    document[last] = value


def remove(document: dict[str, Any], path: str, separator: str = ".") -> None:
    """Delete a value, and documents that it leaves empty."""
    if path in document:
        del document[path]
        return
    first, _, rest = path.partition(separator)
    inner = document.get(first)
    if rest and isinstance(inner, dict):
        remove(inner, rest, separator)
        if not inner:
            del document[first]


def merge(document: dict[str, Any], other: dict[str, Any]) -> None:
    """Take over another document's values: inner documents field by field, arrays whole."""
    for key, value in other.items():
        if isinstance(value, dict) and isinstance(document.get(key), dict):
            merge(document[key], value)
        else:
            document[key] = value


def fields(document: dict[str, Any], separator: str = ".", prefix: str = "") -> Iterator[str]:
    """The paths of all leaves but reserved ones."""
    for key, value in document.items():
        if prefix or key not in RESERVED:
            if isinstance(value, dict):
                yield from fields(value, separator, f"{prefix}{key}{separator}")
            else:
                yield f"{prefix}{key}"


def contains_key(document: dict[str, Any], key: str) -> bool:
    return key in document


def contains_field(document: dict[str, Any], path: str, separator: str = ".") -> bool:
    return path in document or path in set(fields(document, separator))


def pretty(document: dict[str, Any]) -> str:
    """JSON on several lines; what JSON lacks as its text."""
    return json.dumps(document, indent=2, ensure_ascii=False, default=str)
