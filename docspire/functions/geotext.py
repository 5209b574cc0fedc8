"""WKT and GeoJSON: POINT, LINESTRING, POLYGON and their MULTI forms.

A parsed geometry is ``{kind, parts}``: parts are rings or lines, each an array
of ``{x, y}``; of polygons in a multi-polygon `part_of` numbers the polygon.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import bounds

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
TYPE = "kind string, part_of array<int>, parts array<array<struct<x:double,y:double>>>"
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _nested(kind: str, coords: list) -> dict:
    """From GeoJSON's nesting of coordinates."""
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    if kind == "POINT":
        return {"kind": kind, "part_of": [0], "parts": [[point(coords)]]}
    if kind in ("LINESTRING", "MULTIPOINT"):
        parts = [[point(p) for p in coords]] if kind == "LINESTRING" else [[point(p)] for p in coords]
        return {"kind": kind, "part_of": list(range(len(parts))) if kind == "MULTIPOINT" else [0], "parts": parts}
    if kind in ("POLYGON", "MULTILINESTRING"):
        parts = [[point(p) for p in ring] for ring in coords]
        return {"kind": kind, "part_of": [0] * len(parts) if kind == "POLYGON" else list(range(len(parts))), "parts": parts}
    parts = [[point(p) for p in ring] for polygon in coords for ring in polygon]
    return {"kind": kind, "part_of": [k for k, polygon in enumerate(coords) for _ in polygon], "parts": parts}


def parse_wkt(text: str) -> dict:
    """A geometry from well-known text; an unknown or broken one is an error."""
    m = re.fullmatch(r"\s*([A-Z]+)\s*(\(.*\))\s*", text, re.S)
    if not m or m[1] not in KINDS:
        raise ValueError(f"not a geometry: {text[:60]}")

    def read(s: str) -> list:
        """Parentheses as lists, numbers in pairs."""
        s = s.strip()
        if not (s.startswith("(") and s.endswith(")")):
            raise ValueError(f"not coordinates: {s[:60]}")
        inner, depth, parts, start = s[1:-1], 0, [], 0
        for i, c in enumerate(inner):
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise ValueError(f"not coordinates: {s[:60]}")
            if c == "," and not depth:
                parts.append(inner[start:i])
                start = i + 1
        parts.append(inner[start:])
        if depth:
            raise ValueError(f"not coordinates: {s[:60]}")
        return [read(p) if "(" in p else _pair(p) for p in parts]

    def _pair(p: str) -> list[float]:
        words = p.split()
        if len(words) < 2 or not all(_NUMBER.fullmatch(w) for w in words):
            raise ValueError(f"not a position: {p[:60]}")
        return [float(words[0]), float(words[1])]

    coords = read(m[2])
    if m[1] == "POINT":
        coords = coords[0]
    elif m[1] == "MULTIPOINT":
        coords = [c[0] if isinstance(c[0], list) else c for c in coords]
    return _nested(m[1], coords)


def parse_geojson(text: str) -> dict:
    """A geometry from GeoJSON; of a feature or collection the first geometry inside."""
    at = json.loads(text)
    todo = [at]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            kind = str(x.get("type", "")).upper()
            if kind in KINDS and "coordinates" in x:
                return _nested(kind, x["coordinates"])
            todo = [x[k] for k in ("geometry", "geometries", "features") if k in x] + todo
        elif isinstance(x, list):
            todo = x + todo
    raise ValueError(f"no geometry in {text[:60]}")


def _column(parse, strict: bool):
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(parse(t) if t is not None else {"kind": None, "part_of": None, "parts": None})
            except (ValueError, KeyError, TypeError, IndexError) as e:
                if strict:
                    raise ValueError(str(e)) from e
                rows.append({"kind": None, "part_of": None, "parts": None})
        return pd.DataFrame(rows, columns=["kind", "part_of", "parts"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, TYPE)


def box(geometry: Column) -> Column:
    """The box of a parsed geometry, of all its parts."""
    return bounds(F.flatten(geometry["parts"]))


def from_wkt(text: Column, strict: bool = True) -> Column:
    """Parsed text; what can't be read is an error, or null fields if not `strict`."""
    return _column(parse_wkt, strict)(text)


def from_geojson(text: Column, strict: bool = True) -> Column:
    return _column(parse_geojson, strict)(text)
