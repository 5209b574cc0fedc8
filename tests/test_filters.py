"""Filters against a plain evaluator of their rules, on random trees and by hand."""

import math
import random

import pytest

from docspire.plans.filters import FilterError, and_, all_, field_, not_, or_
from docspire.plans.find import find

ROWS = [
    (1, 5, 5.0, "ab", [1, 2], None, ("x", 3)), (2, None, 2.5, "b", None, True, None), (3, -1, None, None, [], False, ("y", None)),
    (4, 7, float("nan"), "abc", [2, None], True, ("x", 9)), (5, 0, -0.5, "", [7], None, (None, 0)),
]
SCHEMA = "_id bigint, i int, f double, s string, a array<int>, b boolean, d struct<k:string,n:int>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def kind(v):
    return None if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else type(v).__name__


def same(a, b):
    if a is None or b is None:
        return a is b
    if kind(a) != kind(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b or kind(a) == "float" and math.isnan(a) and math.isnan(b)


def below(a, b):
    """a < b in the total order of numbers, or within one kind."""
    if {kind(a), kind(b)} <= {"int", "float"}:
        nan = lambda v: isinstance(v, float) and math.isnan(v)
        key = lambda v: (nan(v), 0 if nan(v) else v, kind(v) == "float")
        return key(a) < key(b)
    return kind(a) == kind(b) and a < b


def get(row, path):
    out = row
    for step in path.split("."):
        out = out.get(step) if isinstance(out, dict) else None
    return out


def expected(tree, row):
    op = tree[0]
    if op in ("and", "or"):
        parts = [expected(t, row) for t in tree[1]]
        return all(parts) if op == "and" else any(parts)
    if op == "not":
        return not expected(tree[1], row)
    v, lit = get(row, tree[1]), tree[2]
    if op == "eq":
        return same(v, lit) or isinstance(v, list) and lit is not None and any(same(x, lit) for x in v)
    if op == "ne":
        return not same(v, lit)
    if op == "in":
        return any(expected(("eq", tree[1], x), row) for x in lit)
    if op == "nin":
        return not any(same(v, x) for x in lit)
    if v is None or lit is None or isinstance(v, list) or kind(v) != kind(lit) and not {kind(v), kind(lit)} <= {"int", "float"}:
        return False
    return {"gt": below(lit, v), "lt": below(v, lit), "gte": not below(v, lit), "lte": not below(lit, v)}[op]


def build(tree):
    op = tree[0]
    if op in ("and", "or"):
        return (and_ if op == "and" else or_)(*map(build, tree[1]))
    if op == "not":
        return not_(build(tree[1]))
    f = field_(tree[1])
    return {"eq": f.eq, "ne": f.ne, "in": f.in_array, "nin": f.not_in_array, "gt": f.gt, "lt": f.lt, "gte": f.gte, "lte": f.lte}[op](tree[2])


def random_tree(rng, depth):
    if depth and rng.random() < 0.5:
        op = rng.choice(["and", "or", "not"])
        return (op, random_tree(rng, depth - 1)) if op == "not" else (op, [random_tree(rng, depth - 1) for _ in range(2)])
    value = lambda: rng.choice([None, 5, 5.0, 2, 0, 2.5, "ab", "b", True, float("nan"), -1, 9])
    path = rng.choice(["i", "f", "s", "a", "b", "d.k", "d.n", "gone", "d.gone"])
    op = rng.choice(["eq", "ne", "in", "nin", "gt", "lt", "gte", "lte"])
    return (op, path, [value() for _ in range(3)] if op in ("in", "nin") else value())


def test_random_trees(rows):
    from pyspark.sql import functions as F

    from docspire.operators.write import matching

    plain = [r.asDict(recursive=True) for r in rows.collect()]
    rng = random.Random(7)
    trees = [random_tree(rng, 3) for _ in range(160)]
    for lo in range(0, len(trees), 40):
        group = trees[lo : lo + 40]
        got = rows.select("_id", *[matching(rows, build(t)).alias(f"t{k}") for k, t in enumerate(group)]).orderBy("_id").collect()
        for row, out in zip(plain, got, strict=True):
            for k, t in enumerate(group):
                assert out[f"t{k}"] == expected(t, row), (t, row)
    assert rows.filter(F.lit(True)).count() == 5


def test_int_never_equals_float(rows):
    assert ids(find(rows, field_("i").eq(5.0))) == []
    assert ids(find(rows, field_("i").lte(5.0))) == [1, 3, 5]
    assert ids(find(rows, field_("i").gte(5.0))) == [4]
    assert ids(find(rows, field_("f").lte(5))) == [2, 5]
    assert ids(find(rows, field_("f").gt(5))) == [1, 4]


def test_arrays(rows):
    assert ids(find(rows, field_("a").eq(2))) == [1, 4]
    assert ids(find(rows, field_("a").eq([1, 2]))) == [1]
    assert ids(find(rows, field_("a").ne(2))) == [1, 2, 3, 4, 5]
    assert ids(find(rows, field_("a").in_array([7, 1]))) == [1, 5]
    assert ids(find(rows, field_("a").elem_match(and_(field_("$").gt(1), field_("$").lt(3))))) == [1, 4]
    assert ids(find(rows, not_(field_("a").elem_match(field_("$").gte(2))))) == [2, 3]


def test_element_filter_errors(rows):
    with pytest.raises(FilterError):
        find(rows, field_("i").elem_match(field_("$").eq(1)))
    with pytest.raises(FilterError):
        find(rows, field_("a").elem_match(field_("$").elem_match(field_("$").eq(1))))
    with pytest.raises(FilterError):
        find(rows, field_("a").elem_match(field_("$").text("x")))


def test_regex_and_text(rows):
    assert ids(find(rows, field_("s").text_regex("^a"))) == [1, 4]
    assert ids(find(rows, field_("i").text_regex("^a"))) == []
    for bad in ("(?=a)b", "(?<!a)b", r"(a)\1"):
        with pytest.raises(FilterError):
            find(rows, field_("s").text_regex(bad))
    assert ids(find(rows, not_(field_("s").text("b")))) == [3, 5]
    for bad in ("*", "two words", "a-b"):
        with pytest.raises(FilterError):
            find(rows, field_("s").text(bad))


def test_exists(rows):
    assert ids(find(rows, field_("s").exists())) == [1, 2, 3, 4, 5]
    assert ids(find(rows, field_("d.k").exists())) == [1, 3, 4, 5]
    assert ids(find(rows, field_("gone").exists())) == []


def test_all_and_bounds(rows):
    assert ids(find(rows, all_())) == [1, 2, 3, 4, 5]
    assert ids(find(rows, field_("i").between(0, 5, True, False))) == [5]
    assert ids(find(rows, field_("i").between_inclusive(0, 5, True))) == [1, 5]
    assert ids(find(rows, field_("i").between_optional_inclusive(0, 7))) == [1, 4, 5]


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id _id", "int(id) i").write.parquet(str(tmp_path / "t"))
    df = find(spark.read.parquet(str(tmp_path / "t")), and_(field_("i").gte(5), not_(field_("i").gt(9))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,5)" in plan and "LessThanOrEqual(i,9)" in plan
    assert ids(df) == [5, 6, 7, 8, 9]
