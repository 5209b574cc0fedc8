"""Registered queries of the engine's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geotext, spatial, vector
from .functions.spatial import Geometry
from .functions.stopwords import ENGLISH
from .operators import cursor, migrate, write
from .operators.rag import Search
from .operators.repository import Repository, entity
from .plans.filters import all_, and_, by_id, field_, not_, or_, where
from .plans.find import Context, FindOptions, find, order_by
from .sources.shared import cut, scratch
from .sources.store import Conflict, ConstraintError, Database
from .sources.textindex import TextIndex
from .sources.vectorindex import VectorIndex
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filtered(name: str, table: str, node, columns: list[str], sql_where: str) -> None:
    """A filter over one table: its matching rows' columns."""

    @_register(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql_where}")  # noqa: S608
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(_t(spark, sf_dir, table), node).select(*columns)


_L = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
_O = ["o_orderkey", "o_custkey", "o_totalprice"]
_filtered("f_all", "nation", all_(), ["n_nationkey", "n_name"], "true")
_filtered("f_eq", "orders", field_("o_orderstatus").eq("F"), _O, "o_orderstatus IS NOT DISTINCT FROM 'F'")
_filtered("f_eq_int_never_float", "lineitem", or_(field_("l_linenumber").eq(3.0), field_("l_quantity").eq(5), field_("l_linenumber").eq(6), field_("l_quantity").eq(7.0)), _L, "l_linenumber = 6 OR l_quantity = 7")
_filtered("f_ne", "customer", field_("c_mktsegment").ne("BUILDING"), ["c_custkey", "c_mktsegment"], "c_mktsegment IS DISTINCT FROM 'BUILDING'")
_filtered("f_gt", "lineitem", field_("l_quantity").gt(45.0), _L, "l_quantity > 45")
_filtered("f_gte", "lineitem", field_("l_linenumber").gte(6), _L, "l_linenumber >= 6")
_filtered("f_gte_int_vs_float", "lineitem", field_("l_linenumber").gte(6.0), _L, "l_linenumber > 6")
_filtered("f_lt", "lineitem", field_("l_discount").lt(0.02), _L, "l_discount < 0.02")
_filtered("f_lte", "lineitem", field_("l_quantity").lte(3.0), _L, "l_quantity <= 3")
_filtered("f_lte_float_vs_int", "lineitem", field_("l_quantity").lte(3), _L, "l_quantity < 3")
_filtered("f_between_optional", "orders", field_("o_totalprice").between_optional_inclusive(1000.0, 50000.0), _O, "o_totalprice BETWEEN 1000 AND 50000")
_filtered("f_between_inclusive", "part", field_("p_size").between_inclusive(10, 20, False), ["p_partkey", "p_size"], "p_size > 10 AND p_size < 20")
_filtered("f_between", "part", field_("p_size").between(10, 20, True, False), ["p_partkey", "p_size"], "p_size >= 10 AND p_size < 20")
_filtered("f_in", "orders", field_("o_orderpriority").in_array(["1-URGENT", "2-HIGH", None]), _O, "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
_filtered("f_not_in", "orders", field_("o_orderpriority").not_in_array(["1-URGENT", "2-HIGH"]), _O, "o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_filtered("f_regex", "part", field_("p_name").text_regex("^[a-m].*[aeiou]"), ["p_partkey", "p_name"], "regexp_matches(p_name, '^[a-m].*[aeiou]')")
_filtered("f_and", "lineitem", and_(field_("l_returnflag").eq("R"), field_("l_discount").gte(0.05), field_("l_quantity").lt(24.0)), _L, "l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity < 24")
_filtered("f_or", "lineitem", or_(field_("l_quantity").lt(2.0), field_("l_linenumber").eq(7)), _L, "l_quantity < 2 OR l_linenumber = 7")
_filtered("f_not", "lineitem", not_(or_(field_("l_quantity").lt(40.0), field_("l_returnflag").eq("N"))), _L, "NOT coalesce(l_quantity < 40 OR l_returnflag = 'N', false)")
_filtered("f_custom", "supplier", where(lambda get: get("s_suppkey") % 3 == 1), ["s_suppkey", "s_name"], "s_suppkey % 3 = 1")


def _present(spark, sf_dir):
    """Orders of which a third lack a field, and of the others a part has it as null."""
    key, held = F.col("o_orderkey"), F.col("o_orderkey") % 3 != 0
    names = F.when(held, F.array(F.lit("o_orderkey"), F.lit("note"))).otherwise(F.array(F.lit("o_orderkey")))
    return _t(spark, sf_dir, "orders").select(key, F.when(held & (key % 5 != 0), F.col("o_custkey")).alias("note"), names.alias("_fields"))


@_register("f_exists", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def _exists(spark, sf_dir):
    node = and_(field_("note").exists(), not_(field_("nothing").exists()))
    return find(_present(spark, sf_dir), node, None, Context("o_orderkey", present="_fields")).select("o_orderkey")


@_register("f_missing_field", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_custkey IS NULL")
def _missing(spark, sf_dir):
    node = and_(field_("nothing").eq(None), field_("note").eq(None), not_(field_("nothing").gt(1)))
    return find(_present(spark, sf_dir), node).select("o_orderkey")



@_register("f_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def _by_id(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey"))
    return find(rows, by_id(42)).select("c_custkey", "c_name")


_BUILT: dict[tuple[str, str, str], str] = {}


def _built(spark: SparkSession, sf_dir: str, what: str, build: Callable[[str], None]) -> str:
    """The folder of a table or index that is built once for a session and input, as a database builds it once for a collection."""
    at = (spark.sparkContext.applicationId, sf_dir, what)
    if at not in _BUILT:
        folder = scratch(spark)
        build(folder)
        _BUILT[at] = folder
    return _BUILT[at]


def _orders_with_items(spark, sf_dir):
    """Orders as documents with their items inside, written once: their making is no part of the queries on them."""

    def build(folder: str) -> None:
        items = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
            F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))).alias("items"),
            F.collect_list("l_linenumber").alias("lines"),
        )
        items.write.parquet(folder)

    return spark.read.parquet(_built(spark, sf_dir, "orders", build))


@_register("f_array_eq", "SELECT l_orderkey AS orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 7)")
def _array_eq(spark, sf_dir):
    return find(_orders_with_items(spark, sf_dir), field_("lines").eq(7)).select("orderkey", F.size("lines").cast("bigint").alias("n"))


@_register("f_elem_match", "SELECT l_orderkey AS orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 48 AND l_returnflag = 'R')")
def _elem_match(spark, sf_dir):
    node = field_("items").elem_match(and_(field_("quantity").gt(48.0), field_("flag").eq("R")))
    return find(_orders_with_items(spark, sf_dir), node).select("orderkey")


@_register("f_elem_match_scalar", "SELECT l_orderkey AS orderkey FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linenumber >= 3)")
def _elem_scalar(spark, sf_dir):
    return find(_orders_with_items(spark, sf_dir), not_(field_("lines").elem_match(field_("$").gte(3)))).select("orderkey")


@_register("f_path_over_array", "SELECT l_orderkey AS orderkey, count(DISTINCT l_returnflag)::BIGINT AS flags FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A')")
def _path(spark, sf_dir):
    from .functions.paths import resolve

    rows = find(_orders_with_items(spark, sf_dir), field_("items.flag").eq("A"))
    return rows.select("orderkey", F.size(resolve(rows.schema, "items.flag").column).cast("bigint").alias("flags"))


@_register("f_json_path", "SELECT event_id, user_id FROM events WHERE (json_extract(props, '$.k'))::BIGINT BETWEEN 10 AND 20")
def _json_path(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))
    return find(rows, field_("props.k").between(10, 20, True, True)).select("event_id", "user_id")


@_register("c_count", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000")
def _count(spark, sf_dir):
    return find(_t(spark, sf_dir, "orders"), field_("o_totalprice").gt(100000.0)).agg(F.count(F.lit(1)).alias("n"))


@_register("c_first", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 1")
def _first(spark, sf_dir):
    return find(_t(spark, sf_dir, "customer"), field_("c_acctbal").lt(0.0), FindOptions().limit(1), Context("c_custkey")).select("c_custkey", "c_name")


def _ranked(rows: DataFrame, *columns) -> DataFrame:
    """The rows with their place in the order that `rows` has.

    A sort leaves ranges of rows in order of partitions. Written once, each row
    knows its partition and its number there; the partitions' sizes, a row for
    each, give what comes before.
    """
    id_ = F.monotonically_increasing_id()
    placed = cut(rows.select(*columns, F.shiftright(id_, 33).alias("_part"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = placed.groupBy("_part").agg((F.max("_at") + 1).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


@_register("sort_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_totalprice > 300000")
def _sort_multi(spark, sf_dir):
    options = order_by("o_orderpriority").sort_by("o_totalprice", "desc")
    return _ranked(find(_t(spark, sf_dir, "orders"), field_("o_totalprice").gt(300000.0), options, Context("o_orderkey")), "o_orderkey", "o_orderpriority", "o_totalprice")


_NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k FROM orders)"


def _sort_nulls(name: str, order: str, sql_order: str) -> None:
    @_register(name, f"SELECT o_orderkey, coalesce(k, -1) AS k, row_number() OVER (ORDER BY k {sql_order}, o_orderkey) AS place FROM {_NULLS}")  # noqa: S608
    def run(spark, sf_dir):
        rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
        return _ranked(find(rows, None, order_by("k", order), Context("o_orderkey")), "o_orderkey", F.coalesce("k", F.lit(-1)).alias("k"))


_sort_nulls("sort_nulls", "asc", "ASC NULLS FIRST")
_sort_nulls("sort_nulls_desc", "desc", "DESC NULLS LAST")


@_register("skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 100")
def _skip_limit(spark, sf_dir):
    return find(_t(spark, sf_dir, "orders"), None, order_by("o_totalprice", "desc").skip(100).limit(25), Context("o_orderkey")).select("o_orderkey", "o_totalprice")


@_register("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, l_orderkey * 10 + l_linenumber AS _id FROM lineitem) WHERE l_quantity >= 10 AND l_discount < 0.05 ORDER BY l_extendedprice DESC, _id LIMIT 20")
def _topk(spark, sf_dir):
    """The flagship: filter, sort and limit over the largest table."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = find(rows, and_(field_("l_quantity").gte(10.0), field_("l_discount").lt(0.05)), order_by("l_extendedprice", "desc").limit(20))
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice")


@_register("sort_collated", "WITH t AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation) SELECT n_nationkey, name, row_number() OVER (ORDER BY lower(name), n_nationkey) AS place FROM t")
def _collated(spark, sf_dir):
    """Names of both cases: in order of bytes all capitals would come first."""
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    return _ranked(find(rows, None, order_by("name"), Context("n_nationkey")), "n_nationkey", "name")


@_register("or_union_dedup", "SELECT event_id FROM events WHERE event_type = 'click' UNION SELECT event_id FROM events WHERE value > 50")
def _or_union(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    parts = [find(rows, field_("event_type").eq("click")), find(rows, field_("value").gt(50.0))]
    return cursor.union_distinct(parts, "event_id").select("event_id")


@_register("or_single_pass", "SELECT event_id FROM events WHERE event_type = 'click' OR value > 50")
def _or_single(spark, sf_dir):
    return find(_t(spark, sf_dir, "events"), or_(field_("event_type").eq("click"), field_("value").gt(50.0))).select("event_id")


@_register("project_nested", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, true AS gone FROM customer")
def _project(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.struct(F.col("c_mktsegment").alias("segment")).alias("market")).alias("account"))
    out = cursor.project(rows, {"name": None, "account": {"balance": None, "market": {"segment": None}}, "nothing": None})
    return out.select("name", "account.balance", "account.market.segment", F.col("nothing").isNull().alias("gone"))


@_register("lookup_join", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n, coalesce(min(o_orderkey), -1) AS first_order, coalesce(sum(o_totalprice), 0)::DECIMAL(30, 2)::DOUBLE AS total FROM customer LEFT JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey GROUP BY 1")
def _lookup(spark, sf_dir):
    joined = cursor.lookup_join(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "orders", "o_orderkey")
    total = F.aggregate("orders", F.lit(0).cast("decimal(30,2)"), lambda a, o: (a + o["o_totalprice"].cast("decimal(20,2)")).cast("decimal(30,2)"))
    return joined.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.get(F.col("orders"), F.lit(0))["o_orderkey"], F.lit(-1)).alias("first_order"), F.coalesce(total.cast("double"), F.lit(0.0)).alias("total"))


@_register("lookup_join_nulls", "WITH l AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation), r AS (SELECT r_name, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END AS k FROM region) SELECT n_nationkey, r_name FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k")
def _lookup_nulls(spark, sf_dir):
    left = _t(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("k"))
    right = _t(spark, sf_dir, "region").select("r_name", F.when(F.col("r_regionkey") != 2, F.col("r_regionkey")).alias("k"))
    joined = cursor.lookup_join(left, right, "k", "k", "regions", "r_name")
    return joined.select("n_nationkey", F.explode("regions").alias("r")).select("n_nationkey", "r.r_name")


# Places: points on a grid from the keys, so both engines have the same ones.
def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(k.alias("_id"), F.struct(((k * 37) % 360 - 180).cast("double").alias("x"), ((k * 61) % 180 - 90).cast("double").alias("y")).alias("at"))


_POINTS = "(SELECT c_custkey AS _id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS x, ((c_custkey * 61) % 180 - 90)::DOUBLE AS y FROM customer)"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat} - y) / 2), 2) + cos(radians(y)) * cos(radians({lat})) * pow(sin(radians({lon} - x) / 2), 2))))"
_RING = [(-100.0, -40.0), (60.0, -50.0), (90.0, 35.0), (0.0, 60.0), (-20.0, 0.0)]


def _place(name: str, node, where_sql: str) -> None:
    @_register(name, f"SELECT _id FROM {_POINTS} WHERE {where_sql}")  # noqa: S608
    def run(spark, sf_dir):
        return find(_points(spark, sf_dir), node).select("_id")


def _ring_sql() -> str:
    edges = []
    for (xi, yi), (xj, yj) in zip(_RING, [_RING[-1], *_RING[:-1]], strict=True):
        edges.append(f"((({yi} > y) <> ({yj} > y)) AND x < {xj - xi} * (y - {yi}) / {yj - yi} + {xi})::INT")
    return f"({' + '.join(edges)}) % 2 = 1"


_place("geo_intersects_envelope", field_("at").intersects(Geometry.envelope(-50, -20, 30, 40)), "x BETWEEN -50 AND 30 AND y BETWEEN -20 AND 40")
_place("geo_intersects_point", field_("at").intersects(Geometry.point(-143, -29)), "x = -143 AND y = -29")
_place("geo_within_circle", field_("at").within(Geometry.circle(10, 10, 45.5)), "sqrt((x - 10) * (x - 10) + (y - 10) * (y - 10)) <= 45.5")
_place("geo_within_polygon", field_("at").within(Geometry.polygon(_RING)), _ring_sql())
_place("geo_near", field_("at").near(0.0, 0.0, 30.0), "sqrt(x * x + y * y) <= 30")
_place("geo_near_meters", field_("at").geo_near(48.2, 16.4, 2_500_000.0), _HAVERSINE.format(lat=48.2, lon=16.4) + " <= 2500000")


@_register("knearest", f"SELECT _id, round(sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)), 6) AS distance FROM {_POINTS} WHERE sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)) <= 60 ORDER BY distance, _id LIMIT 15")  # noqa: S608
def _knearest(spark, sf_dir):
    return find(_points(spark, sf_dir), field_("at").knearest(3.0, 4.0, 15, 60.0)).select("_id", F.round("_distance", 6).alias("distance"))


@_register("geo_knearest", f"SELECT _id, round(sqrt((x - 16) * (x - 16) + (y - 48) * (y - 48)), 6) AS distance FROM {_POINTS} WHERE sqrt((x - 16) * (x - 16) + (y - 48) * (y - 48)) <= 5000000 / 111000.0 ORDER BY distance, _id LIMIT 10")  # noqa: S608
def _geo_knearest(spark, sf_dir):
    return find(_points(spark, sf_dir), field_("at").geo_knearest(48.0, 16.0, 10, 5_000_000.0)).select("_id", F.round("_distance", 6).alias("distance"))


@_register("haversine", f"SELECT _id, round({_HAVERSINE.format(lat=48.2, lon=16.4)} / 1000, 3) AS km FROM {_POINTS}")  # noqa: S608
def _haversine(spark, sf_dir):
    meters = spatial.haversine(F.col("at.y"), F.col("at.x"), 48.2, 16.4)
    return _points(spark, sf_dir).select("_id", F.round(meters / 1000, 3).alias("km"))


@_register("box_operations", f"WITH b AS (SELECT _id, x - 20 AS x0, y - 10 AS y0, x + 20 AS x1, y + 10 AS y1 FROM {_POINTS}) SELECT _id, (least(x1, 50) - greatest(x0, -50)) * (least(y1, 50) - greatest(y0, -50)) AS overlap, x0 >= -50 AND x1 <= 50 AND y0 >= -50 AND y1 <= 50 AS inside FROM b WHERE x0 <= 50 AND x1 >= -50 AND y0 <= 50 AND y1 >= -50")  # noqa: S608
def _boxes(spark, sf_dir):
    lit = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("min_x", "min_y", "max_x", "max_y"), strict=True)])
    x, y = F.col("at.x"), F.col("at.y")
    box = F.struct((x - 20).alias("min_x"), (y - 10).alias("min_y"), (x + 20).alias("max_x"), (y + 10).alias("max_y"))
    frame = lit(-50, -50, 50, 50)
    rows = _points(spark, sf_dir).select("_id", box.alias("box"))
    both = spatial.Box.intersection(F.col("box"), frame)
    return rows.filter(spatial.Box.intersects(F.col("box"), frame)).select("_id", spatial.Box.area(both).alias("overlap"), spatial.Box.contains(frame, F.col("box")).alias("inside"))


# Text.
_TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0c\\x0b\\x{a0}\\x{feff}#!\\\\\"%&''()+\\-.,*/:;<=>?@\\[\\]^_`{|}~\\x{201c}\\x{201d}\\x{2033}]+'), lambda x: x <> '')"


def _documents_index(spark: SparkSession, sf_dir: str, stop_words: frozenset[str] = frozenset()) -> TextIndex:
    folder = _built(spark, sf_dir, "text", lambda folder: TextIndex.build(_t(spark, sf_dir, "documents"), "text", "doc_id", folder))
    return TextIndex(spark, [folder], stop_words)


class _WhenAsked:
    """An index that is built when a search first asks it; a filter that reads texts builds none."""

    def __init__(self, build: Callable[[], TextIndex]):
        self._build = build

    def __getattr__(self, name: str):
        return getattr(self._build(), name)


def _in_documents(spark: SparkSession, sf_dir: str, node) -> DataFrame:
    index = _WhenAsked(lambda: _documents_index(spark, sf_dir, ENGLISH))
    return find(_t(spark, sf_dir, "documents"), node, None, Context("doc_id", text_tables={"text": index}))


def _text(name: str, node, where_sql: str) -> None:
    @_register(name, f"SELECT doc_id FROM documents WHERE {where_sql}")  # noqa: S608
    def run(spark, sf_dir):
        return _in_documents(spark, sf_dir, node).select("doc_id")


_text("text_term", field_("text").text("Tion"), f"list_contains({_TOKENS}, 'Tion')")
_text("text_term_insensitive", field_("text").text_case_insensitive("TION"), f"list_contains(list_transform({_TOKENS}, lambda x: lower(x)), 'tion')")
_text("text_prefix", field_("text").text("thatn*"), f"len(list_filter({_TOKENS}, lambda x: starts_with(x, 'thatn'))) > 0")
_text("text_suffix", field_("text").text("*tionea"), f"len(list_filter({_TOKENS}, lambda x: ends_with(x, 'tionea') OR ends_with(lower(x), 'tionea'))) > 0")
_text("text_contains", field_("text").text("*ngtion*"), f"len(list_filter({_TOKENS}, lambda x: contains(x, 'ngtion') OR contains(lower(x), 'ngtion'))) > 0")
_text("text_not_is_substring", not_(field_("text").text("tion and")), "NOT contains(text, 'tion and')")


@_register("text_scan", f"SELECT doc_id FROM documents WHERE list_contains(list_transform({_TOKENS}, lambda x: lower(x)), 'tion') AND len(list_filter({_TOKENS}, lambda x: contains(x, 'ngtion') OR contains(lower(x), 'ngtion'))) > 0")  # noqa: S608
def _text_scan(spark, sf_dir):
    """The same searches without an index."""
    return find(_t(spark, sf_dir, "documents"), and_(field_("text").text_case_insensitive("TION"), field_("text").text("*ngtion*"))).select("doc_id")


def _lower_tokens(word: str) -> str:
    return f"len(list_filter(ts, lambda x: x = '{word}'))::DOUBLE"


@_register("phrase", f"""WITH d AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS ts FROM documents),
c AS (SELECT doc_id, len(ts)::DOUBLE AS n, {_lower_tokens('of')} AS a, {_lower_tokens('the')} AS b, contains(' ' || array_to_string(ts, ' ') || ' ', ' of the ') AS hit FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::DOUBLE AS rows, avg(n) AS mean, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db FROM c)
SELECT doc_id, round(ln(1 + (rows - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (rows - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE hit""")  # noqa: S608
def _phrase(spark, sf_dir):
    return _in_documents(spark, sf_dir, field_("text").phrase("of the")).select("doc_id", F.round("_score", 6).alias("score"))


@_register("bm25_topk", f"""WITH d AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS ts FROM documents),
c AS (SELECT doc_id, len(ts)::DOUBLE AS n, len(list_filter(ts, lambda x: x = 'tion'))::DOUBLE AS a, len(list_filter(ts, lambda x: x = 'thing'))::DOUBLE AS b FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::DOUBLE AS rows, avg(n) AS mean, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db FROM c)
SELECT doc_id, round(ln(1 + (rows - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (rows - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 20""")  # noqa: S608
def _bm25(spark, sf_dir):
    found = _in_documents(spark, sf_dir, field_("text").matches("tion thing", 20))
    return found.select("doc_id", F.round("_score", 6).alias("score"))


@_register("fts_boolean", f"WITH d AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS ts FROM documents) SELECT doc_id FROM d WHERE list_contains(ts, 'tion') AND NOT list_contains(ts, 'thing')")  # noqa: S608
def _fts_boolean(spark, sf_dir):
    return _in_documents(spark, sf_dir, field_("text").matches("tion AND NOT thing")).select("doc_id")


_register("bm25_scan", _SQL["bm25_topk"])(
    lambda spark, sf_dir: find(_t(spark, sf_dir, "documents"), field_("text").matches("tion thing", 20), None, Context("doc_id")).select("doc_id", F.round("_score", 6).alias("score"))
)


@_register("fts_nested", f"WITH d AS (SELECT doc_id, list_transform({_TOKENS.replace('text', "substring(text, 1, 400) || ' ' || substring(text, 401)", 1)}, lambda x: lower(x)) AS ts FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM d WHERE list_contains(ts, 'tion') AND list_contains(ts, 'thing')")  # noqa: S608
def _fts_nested(spark, sf_dir):
    """Text inside documents and arrays, and two ranked filters on one field, each of which holds."""
    body = F.struct(F.substring("text", 1, 400).alias("head"), F.array(F.expr("substring(text, 401)")).alias("rest"))
    rows = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", body.alias("body"))
    return find(rows, and_(field_("body").matches("tion"), field_("body").matches("thing")), None, Context("doc_id")).select("doc_id")


# Vectors: the query is a fixed direction.
_Q = [round(((i * 7) % 11 - 5) / 5, 2) for i in range(64)]
_QSQL = f"[{', '.join(map(str, _Q))}]::DOUBLE[]"
_V = "embedding::DOUBLE[]"


@_register("knn_cosine", f"SELECT vec_id, round(list_cosine_similarity({_V}, {_QSQL}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity({_V}, {_QSQL}) DESC, vec_id LIMIT 10")  # noqa: S608
def _cosine(spark, sf_dir):
    return find(_t(spark, sf_dir, "embeddings"), field_("embedding").nearest(_Q, 10), None, Context("vec_id")).select("vec_id", F.round("_score", 6).alias("score"))


@_register("knn_l2", f"SELECT vec_id, round(1 / (1 + list_distance({_V}, {_QSQL})), 6) AS score FROM embeddings ORDER BY list_distance({_V}, {_QSQL}), vec_id LIMIT 10")  # noqa: S608
def _l2(spark, sf_dir):
    return find(_t(spark, sf_dir, "embeddings"), field_("embedding").nearest(_Q, 10, "euclidean"), None, Context("vec_id")).select("vec_id", F.round("_score", 6).alias("score"))


@_register("knn_dot", f"SELECT vec_id, round(list_dot_product({_V}, {_QSQL}), 6) AS score FROM embeddings ORDER BY list_dot_product({_V}, {_QSQL}) DESC, vec_id LIMIT 10")  # noqa: S608
def _dot(spark, sf_dir):
    return find(_t(spark, sf_dir, "embeddings"), field_("embedding").nearest(_Q, 10, "dot"), None, Context("vec_id")).select("vec_id", F.round("_score", 6).alias("score"))


@_register("knn_then_filter", f"SELECT vec_id FROM (SELECT * FROM embeddings ORDER BY list_cosine_similarity({_V}, {_QSQL}) DESC, vec_id LIMIT 40) WHERE label = 3")  # noqa: S608
def _knn_filter(spark, sf_dir):
    return find(_t(spark, sf_dir, "embeddings"), and_(field_("label").eq(3), field_("embedding").nearest(_Q, 40)), None, Context("vec_id")).select("vec_id")


@_register("rag_filter_then_knn", f"SELECT vec_id, round(list_cosine_similarity({_V}, {_QSQL}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity({_V}, {_QSQL}) DESC, vec_id LIMIT 8")  # noqa: S608
def _rag(spark, sf_dir):
    found = Search(_t(spark, sf_dir, "embeddings"), tuple(_Q), 8, key="vec_id").filter(field_("label").eq(3)).run()
    return found.select("vec_id", F.round("_score", 6).alias("score"))


@_register("rag_min_score", f"SELECT vec_id FROM embeddings WHERE list_cosine_similarity({_V}, {_QSQL}) >= 0.1 ORDER BY list_cosine_similarity({_V}, {_QSQL}) DESC, vec_id LIMIT 25")  # noqa: S608
def _rag_min(spark, sf_dir):
    return Search(_t(spark, sf_dir, "embeddings"), tuple(_Q), 25, key="vec_id").min_score(0.1).run().select("vec_id")


@_register("knn_ivf", _SQL["knn_cosine"])
def _ivf(spark, sf_dir):
    """By the cells of an index; as many probes as cells, so that the exact search is its oracle."""
    folder = _built(spark, sf_dir, "vectors", lambda folder: VectorIndex.build(_t(spark, sf_dir, "embeddings"), "embedding", "vec_id", folder))
    index = VectorIndex(spark, folder, probes=1 << 30)
    found = find(_t(spark, sf_dir, "embeddings"), field_("embedding").nearest(_Q, 10), None, Context("vec_id", vector_tables={"embedding": index}))
    return found.select("vec_id", F.round("_score", 6).alias("score"))


_DECODED = f"WITH v AS (SELECT vec_id, {_V} AS v, list_min({_V}) AS lo, (list_max({_V}) - list_min({_V})) / 255 AS s FROM embeddings), d AS (SELECT vec_id, v, list_transform(v, lambda x: lo + round_even((x - lo) / s, 0) * s) AS w FROM v)"


@_register("vector_i8_codec", f"{_DECODED} SELECT vec_id, round(list_sum(w), 4) AS total, round(list_max(list_transform(range(1, 65), lambda i: abs(v[i] - w[i]))) / (list_max(v) - list_min(v)) * 255, 3) <= 0.5 AS near FROM d")  # noqa: S608
def _i8(spark, sf_dir):
    """Coded and decoded again: the sum of what comes back, and whether no number is off by more than half a step."""
    v = F.col("v")
    coded = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), vector.encode_i8(F.col("embedding")).alias("c"))
    back = coded.select("vec_id", "v", vector.decode_i8(F.col("c")).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    widest = F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b))) / (F.array_max(v) - F.array_min(v)) * 255
    return back.select("vec_id", F.round(total, 4).alias("total"), (F.round(widest, 3) <= 0.5).alias("near"))


@_register("vector_f16_codec", f"WITH h AS (SELECT vec_id, list_transform({_V}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END) AS w FROM embeddings) SELECT vec_id, round(list_sum(w), 6) AS total, round(list_max(w), 6) AS most FROM h")  # noqa: S608
def _f16(spark, sf_dir):
    half = _t(spark, sf_dir, "embeddings").select("vec_id", vector.encode_f16(F.col("embedding")).alias("w"))
    return half.select("vec_id", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("w"), 6).alias("most"))


# Writes, as the rows that they leave.
@_register("update_merge", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'AMERICAS' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS _revision FROM nation")
def _update(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").withColumn("_id", F.col("n_nationkey").cast("bigint")).withColumn("_revision", F.lit(1))
    return write.merged(rows, field_("n_regionkey").eq(1), {"n_name": "AMERICAS"}).select("n_nationkey", "n_name", "_revision")


@_register("update_just_once", "SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _update_once(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").withColumn("_id", F.col("s_suppkey"))
    return write.merged(rows, field_("s_acctbal").gt(0.0), {"s_acctbal": 0.0}, just_once=True).select("s_suppkey", "s_acctbal")


@_register("upsert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 3, 'THREE' UNION ALL SELECT 4, 'FOUR' UNION ALL SELECT 99, 'NEW'")
def _upsert(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("_id"), "n_nationkey", "n_name")
    new = spark.createDataFrame([(3, 3, "THREE"), (4, 4, "FOUR"), (99, 99, "NEW")], "_id bigint, n_nationkey int, n_name string")
    return write.upserted(rows, new).select("n_nationkey", "n_name")


@_register("remove", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'O', false)")
def _remove(spark, sf_dir):
    return write.removed(_t(spark, sf_dir, "orders"), field_("o_orderstatus").eq("O")).select("o_orderkey")


@_register("unique_violation_rows", "SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def _violations(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").withColumn("_id", F.col("n_nationkey").cast("bigint"))
    return write.violations(rows, ["n_regionkey"]).select(F.col("k.n_regionkey").alias("n_regionkey"), "n")


@_register("migrate_steps", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name AS region_name, 'x' AS flag, length(r_name) AS size FROM region")
def _migrate(spark, sf_dir):
    steps = [migrate.AddField("flag", "x"), migrate.AddField("size", F.length("r_name")), migrate.RenameField("r_name", "region_name"), migrate.ChangeDataType("r_regionkey", lambda c: c.cast("string")), migrate.AddField("gone", 1), migrate.DeleteField("gone")]
    return migrate.rewrite(_t(spark, sf_dir, "region"), steps)


# A database in a folder of its own, with what its writes leave.
def _database(spark: SparkSession) -> Database:
    return Database(spark, scratch(spark))


def _nations(spark: SparkSession, sf_dir: str, db: Database, name: str = "nation"):
    c = db.collection(name)
    c.insert(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region")))
    return c


@_register("store_insert_find", "SELECT n_nationkey::BIGINT AS _id, n_name AS name, n_regionkey::BIGINT AS region, '-' AS city, 1 AS _revision FROM nation WHERE n_regionkey >= 2 UNION ALL SELECT 100, 'new', 7, 'x', 1")
def _insert_find(spark, sf_dir):
    c = _nations(spark, sf_dir, _database(spark))
    c.insert([{"_id": 100, "name": "new", "region": 7, "at": {"city": "x"}}, {"_id": 101, "name": "other", "region": 1}])
    return c.find(field_("region").gte(2)).select("_id", "name", "region", F.coalesce("at.city", F.lit("-")).alias("city"), "_revision")


@_register("store_nested_merge", "SELECT * FROM (VALUES (1::BIGINT, 'x', -1::BIGINT, 1), (2, '-', 5, 1), (3, 'y', 7, 2)) t(_id, city, zip, _revision)")
def _nested(spark, sf_dir):
    """New keys of inner documents, by insert and by update."""
    c = _database(spark).collection("c")
    c.insert([{"_id": 1, "at": {"city": "x"}}])
    c.insert([{"_id": 2, "at": {"zip": 5}}, {"_id": 3, "at": {"city": "y"}}])
    c.update(field_("at.city").eq("y"), {"at": {"zip": 7}})
    return c.find().select("_id", F.coalesce("at.city", F.lit("-")).alias("city"), F.coalesce("at.zip", F.lit(-1)).cast("bigint").alias("zip"), "_revision")


@_register("store_update_remove", "SELECT n_nationkey::BIGINT AS _id, CASE WHEN n_regionkey = 1 THEN 'AMERICAS' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS _revision FROM nation WHERE n_regionkey <> 3")
def _update_remove(spark, sf_dir):
    c = _nations(spark, sf_dir, _database(spark))
    c.update(field_("region").eq(1), {"name": "AMERICAS"})
    c.remove(field_("region").eq(3))
    return c.find().select("_id", "name", "_revision")


@_register("store_unique", "SELECT n_nationkey::BIGINT AS _id, n_name AS name, 'kept' AS outcome FROM nation UNION ALL SELECT 200, 'FRESH', 'kept'")
def _unique(spark, sf_dir):
    """A unique index refuses a name that is taken, and a second index of another kind on it."""
    c = _nations(spark, sf_dir, _database(spark))
    c.create_index(["name"], "unique")
    outcome = "kept"
    for attempt in (lambda: c.insert([{"_id": 201, "name": "NATION_7"}]), lambda: c.insert([{"_id": 3, "name": "SAME ID"}]), lambda: c.update(all_(), {"name": "one"}), lambda: c.create_index(["name"], "full_text")):
        try:
            attempt()
            outcome = "let through"
        except ConstraintError:
            pass
    c.insert([{"_id": 200, "name": "FRESH"}])
    return c.find().select("_id", "name", F.lit(outcome).alias("outcome"))


@_register("store_compound_unique", "SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT 1) t GROUP BY 1")
def _compound(spark, sf_dir):
    """Unique over two fields: the first alone may repeat, both together may not."""
    c = _nations(spark, sf_dir, _database(spark))
    c.create_index(["region", "name"], "unique")
    c.insert([{"_id": 300, "region": 1, "name": "SECOND"}])
    try:
        c.insert([{"_id": 301, "region": 1, "name": "SECOND"}])
    except ConstraintError:
        pass
    return c.find().groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@_register("store_transaction", "SELECT n_nationkey::BIGINT AS _id, n_name AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 400, 'moved'")
def _transaction(spark, sf_dir):
    """One transaction over two collections is committed, one is rolled back, and one meets another writer."""
    db = _database(spark)
    c = _nations(spark, sf_dir, db)
    with db.transaction() as t:
        t.collection("nation").remove(field_("region").eq(0))
        t.collection("other").insert([{"_id": 400, "name": "moved"}])
    lost = db.transaction()
    lost.collection("nation").clear()
    lost.rollback()
    late = db.transaction()
    late.collection("nation").clear()
    db.collection("third").insert([{"_id": 1}])
    try:
        late.commit()
    except Conflict:
        pass
    return c.find().select("_id", "name").unionByName(db.collection("other").find().select("_id", "name"))


@_register("store_two_writers", "SELECT n_nationkey::BIGINT AS _id FROM nation UNION ALL SELECT * FROM (VALUES (500), (501)) t(_id)")
def _two_writers(spark, sf_dir):
    """Two handles of one database write in turn; compaction by the stale one loses nothing."""
    db = _database(spark)
    other = Database(spark, db.root)
    _nations(spark, sf_dir, db)
    other.collection("nation").insert([{"_id": 500}])
    db.collection("nation").insert([{"_id": 501}])
    other.compact(keep=1, grace_s=0)
    return Database(spark, db.root).collection("nation").find().select("_id")


@_register("store_migrate", "SELECT n_nationkey::BIGINT AS _id, n_name AS label, n_regionkey::VARCHAR AS region, 'renamed|label|unique' AS state FROM nation")
def _store_migrate(spark, sf_dir):
    """Fields and the collection are renamed and an index is made; a rename onto a collection that exists is refused."""
    db = _database(spark)
    _nations(spark, sf_dir, db)
    db.collection("taken").insert([{"_id": 1}])
    step = migrate.Migration(1, 2).on("nation", migrate.RenameField("name", "label"), migrate.ChangeDataType("region", lambda c: c.cast("string")), migrate.CreateIndex("unique", ["label"]), migrate.Rename("renamed"))
    db.migrate([step], 2)
    c = db.collection("renamed")
    try:
        db.migrate([migrate.Migration(2, 3).on("renamed", migrate.Rename("taken"))], 3)
    except ConstraintError:
        pass
    state = "|".join([c.name, *[i.name for i in c.indexes()]]) if db.collection("taken").size() == 1 else "overwritten"
    return c.find().select("_id", "label", "region", F.lit(state).alias("state"))


@_register("store_mixed_kinds", "SELECT * FROM (VALUES (2::BIGINT, '5', 1::BIGINT), (3, '7.5', 2), (4, '9', 3)) t(_id, v, place)")
def _mixed(spark, sf_dir):
    """Integers, floats, texts and null in one field: numbers by size, an integer before an equal float."""
    c = _database(spark).collection("c")
    c.insert([{"_id": 1, "v": None}])
    c.insert([{"_id": 2, "v": 5}, {"_id": 4, "v": 9}])
    c.insert([{"_id": 3, "v": 7.5}, {"_id": 6, "v": 4.0}])
    c.insert([{"_id": 5, "v": "text"}, {"_id": 7, "v": True}])
    node = and_(field_("v").gte(5), field_("v").lt(9.5), not_(field_("v").eq(9.0)), field_("v").not_in_array(["text"]))
    found = c.find(node, order_by("v"))
    return _ranked(found, "_id", F.to_json("v").alias("v"))


@_register("change_log_counts", "SELECT 'insert' AS kind, count(*)::BIGINT + 1 AS n, 600::BIGINT AS last_id FROM nation UNION ALL SELECT 'update', count(*), max(n_nationkey)::BIGINT FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'remove', count(*), max(n_nationkey)::BIGINT FROM nation WHERE n_regionkey = 3")
def _changes(spark, sf_dir):
    db = _database(spark)
    db.change_log().count()
    c = _nations(spark, sf_dir, db)
    c.insert([{"_id": 600, "name": "x"}])
    c.update(field_("region").eq(2), {"name": "y"})
    c.remove(field_("region").eq(3))
    return changes.summary(db.change_log())


@_register("change_log_replay", "SELECT n_nationkey::BIGINT AS _id, CASE WHEN n_regionkey = 2 THEN 'y' ELSE n_name END AS name, CASE WHEN n_regionkey = 2 THEN 'update' WHEN n_regionkey = 3 THEN 'remove' ELSE 'insert' END AS kind FROM nation")
def _replay(spark, sf_dir):
    """The last event of each document, with what it held."""
    db = _database(spark)
    c = _nations(spark, sf_dir, db)
    c.update(field_("region").eq(2), {"name": "y"})
    c.remove(field_("region").eq(3))
    last = changes.latest(db.change_log())
    return last.select("_id", F.get_json_object("document", "$.name").alias("name"), "kind")


@_register("repository_join", "SELECT r_name AS name, list_aggregate(list_sort(list(n_name)), 'string_agg', ',') AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _repository_join(spark, sf_dir):
    """Typed repositories joined by key: each region with its nations, as a projection."""
    db = _database(spark)
    regions, nations = Repository(db, _Region), Repository(db, _Nation)
    regions.collection.insert(_t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("name")))
    nations.collection.insert(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region")))
    joined = regions.join(regions.find(), nations.find(), "key", "region", "nations")
    return joined.select("name", F.array_join(F.array_sort(F.transform("nations", lambda n: n["name"])), ",").alias("nations"))


@entity(name="region", id_field="key")
class _Region:
    key: int
    name: str


@entity(name="nation", id_field="key", indexes=(("non_unique", ("region",)),))
class _Nation:
    key: int
    name: str
    region: int


@_register("rag_store", "SELECT n_name AS text FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 2 ORDER BY abs(n_nationkey - 3), n_nationkey LIMIT 3")
def _rag_store(spark, sf_dir):
    """Chunks added, one deleted, filtered by metadata and searched."""
    from .operators.rag import RagStore

    store = RagStore(_database(spark).collection("rag"), 2, "euclidean")
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    ids = store.add_many([(r["n_name"], [float(r["n_nationkey"]), 0.0], {"region": r["n_regionkey"]}) for r in rows])
    store.delete(ids[2])
    return store.search([3.0, 0.0], 3).filter(field_("region").eq(1)).run().select("text")


# Geometry text, lines, rings with holes and layouts.
@_register("wkt_points", f"SELECT _id, x, y FROM {_POINTS}")  # noqa: S608
def _wkt(spark, sf_dir):
    told = _points(spark, sf_dir).select("_id", F.concat(F.lit("POINT ("), F.col("at.x").cast("string"), F.lit(" "), F.col("at.y").cast("string"), F.lit(")")).alias("t"))
    at = F.get(F.flatten("g.parts"), F.lit(0))
    return told.select("_id", geotext.from_wkt(F.col("t")).alias("g")).select("_id", at["x"].alias("x"), at["y"].alias("y"))


@_register("geojson_boxes", f"SELECT _id, x - 1 AS min_x, y AS min_y, x + 2 AS max_x, y + 3 AS max_y FROM {_POINTS}")  # noqa: S608
def _geojson(spark, sf_dir):
    pair = lambda dx, dy: F.concat(F.lit("["), (F.col("at.x") + dx).cast("string"), F.lit(","), (F.col("at.y") + dy).cast("string"), F.lit("]"))
    told = F.concat(F.lit('{"type":"LineString","coordinates":['), pair(-1, 0), F.lit(","), pair(2, 3), F.lit("]}"))
    return _points(spark, sf_dir).select("_id", geotext.box(geotext.from_geojson(told)).alias("b")).select("_id", "b.*")


@_register("wkt_multi_boxes", f"SELECT _id, least(x, 0) AS min_x, least(y, 0) AS min_y, greatest(x, 1) AS max_x, greatest(y, 1) AS max_y FROM {_POINTS}")  # noqa: S608
def _multi(spark, sf_dir):
    """The box of several points, or of several lines, is that of all of them."""
    at = F.concat(F.col("at.x").cast("string"), F.lit(" "), F.col("at.y").cast("string"))
    points, lines = F.concat(F.lit("MULTIPOINT ("), at, F.lit(", 0 0, 1 1)")), F.concat(F.lit("MULTILINESTRING ((0 0, 1 1), ("), at, F.lit(", 1 0))"))
    told = _points(spark, sf_dir).select("_id", F.when(F.col("_id") % 2 == 0, points).otherwise(lines).alias("t"))
    return told.select("_id", geotext.box(geotext.from_wkt(F.col("t"))).alias("b")).select("_id", "b.*")


@_register("line_strings", f"SELECT _id, round(sqrt(x * x + y * y) + sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)), 6) AS length, _id % 2 = 0 AS closed, least(x, y) <= 0 AND greatest(x, y) >= 0 AS crosses FROM {_POINTS} WHERE x <> y")  # noqa: S608
def _lines(spark, sf_dir):
    """From the origin by a point to (3, 4); rings, of which half return to their start; a piece of the diagonal against the other one."""
    pair = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("at.x"), F.col("at.y")
    line = F.array(pair(F.lit(0), F.lit(0)), pair(x, y), pair(F.lit(3), F.lit(4)))
    ring = F.array(pair(x, y), pair(F.lit(0), F.lit(0)), pair(F.lit(3), F.lit(4)), pair(x + F.col("_id") % 2, y))
    piece, other = F.array(pair(x, x), pair(y, y)), F.array(pair(F.lit(-1000), F.lit(1000)), pair(F.lit(1000), F.lit(-1000)))
    rows = _points(spark, sf_dir).filter(x != y)
    return rows.select("_id", F.round(spatial.line_length(line), 6).alias("length"), spatial.line_is_closed(ring).alias("closed"), spatial.lines_intersect(piece, other).alias("crosses"))


@_register("polygon_with_holes", f"SELECT _id FROM {_POINTS} WHERE {_ring_sql()} AND NOT (x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 10)")  # noqa: S608
def _holes(spark, sf_dir):
    pairs = lambda ring: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    hole = F.array(pairs([(-10.5, -20.5), (30.5, -20.5), (30.5, 10.5), (-10.5, 10.5)]))
    return _points(spark, sf_dir).filter(spatial.with_holes_contains(F.col("at.x"), F.col("at.y"), pairs(_RING), hole)).select("_id")


@_register("bounding_boxes", f"SELECT _id % 10 AS g, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {_POINTS} GROUP BY 1")  # noqa: S608
def _bounds(spark, sf_dir):
    grouped = _points(spark, sf_dir).groupBy((F.col("_id") % 10).alias("g")).agg(F.collect_list("at").alias("ps"))
    return grouped.select("g", spatial.bounds(F.col("ps")).alias("b")).select("g", "b.*")


@_register("hilbert_neighbours", "SELECT count(*)::BIGINT AS cells, count(*)::BIGINT - 1 AS steps FROM range(4096)")
def _hilbert(spark, sf_dir):
    """A 64 by 64 grid in the curve's order: every cell once, each next to the one before."""
    grid = spark.range(4096).select((F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"))
    at = grid.select("x", "y", spatial.hilbert_index(F.col("x"), F.col("y"), (0.0, 0.0, 63.0, 63.0), 6).alias("d"))
    near = at.alias("a").join(at.alias("b"), F.col("b.d") == F.col("a.d") + 1).select((F.abs(F.col("a.x") - F.col("b.x")) + F.abs(F.col("a.y") - F.col("b.y"))).alias("step"))
    return near.agg(F.sum((F.col("step") == 1).cast("bigint")).alias("steps")).crossJoin(at.agg(F.count_distinct("d").alias("cells"))).select("cells", "steps")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
