"""Collections, constraints, events, transactions, migrations and repositories."""

from dataclasses import dataclass

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspire.operators import cursor
from docspire.operators import migrate as M
from docspire.operators.rag import RagStore
from docspire.operators.repository import Repository, entity
from docspire.plans.filters import FilterError, all_, by_id, field_
from docspire.plans.find import Context, find, order_by
from docspire.plans.ranked import nearest
from docspire.sources.store import Conflict, ConstraintError, Database
from docspire.sources.vectorindex import VectorIndex
from docspire.streaming import changes


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def names(df):
    return [r["name"] for r in df.collect()]


def test_write_and_read(spark, db):
    c = db.collection("people")
    seen = []
    c.subscribe(seen.append)
    ids = c.insert([{"name": "a", "age": 5, "at": {"city": "x"}}, {"name": "b", "age": 7}, {"name": "c", "nick": None}])
    assert len(set(ids)) == 3 and ids == sorted(ids) and 10**18 <= ids[0] < 10**19 and c.size() == 3
    row = c.get_by_id(ids[0])
    assert row["_revision"] == 1 and row["_modified"] > 1.6e12 and "_fields" not in row.asDict()
    assert names(c.find(field_("nick").exists())) == ["c"] and names(c.find(field_("at.city").exists())) == ["a"]
    assert c.update(field_("age").gte(5), {"age": 9, "at": {"zip": 1}}) == 2
    row = c.get_by_id(ids[0])
    assert (row["age"], row["_revision"], row["at"]["city"], row["at"]["zip"]) == (9, 2, "x", 1)
    assert c.update(field_("age").eq(9), {"age": 1}, just_once=True) == 1 and c.get_by_id(ids[1])["age"] == 9
    assert c.update(field_("name").eq("nobody"), {"name": "new"}) == 0
    assert c.update(field_("name").eq("nobody"), {"name": "new"}, insert_if_absent=True) == 1 and c.size() == 4
    assert c.update_by_id(ids[2], {"name": "cc"}) == 1 and c.remove(by_id(ids[2])) == 1 and c.remove(field_("age").gt(100)) == 0
    with pytest.raises(ConstraintError):
        c.remove(all_(), just_once=True)
    with pytest.raises(ConstraintError):
        c.update_one({"name": "no id"})
    assert [e["kind"] for e in seen] == ["insert", "update", "update", "insert", "update", "remove"]
    log = {r["kind"]: r["count"] for r in db.change_log().groupBy("kind").count().collect()}
    assert log == {"insert": 4, "update": 4, "remove": 1}
    assert names(Database(spark, db.root).collection("people").find(None, order_by("name", "desc"))) == ["new", "b", "a"]


def test_constraints(db):
    c = db.collection("u")
    c.create_index(["name"], "unique")
    c.insert([{"_id": 1, "name": "a"}])
    for bad in ([{"_id": 1, "name": "z"}], [{"_id": 2, "name": "a"}], [{"_id": 3, "name": "q"}, {"_id": 4, "name": "q"}], [{"_id": 5, "name": None}, {"_id": 6, "name": None}]):
        with pytest.raises(ConstraintError):
            c.insert(bad)
    c.insert([{"_id": 7, "name": None}])
    with pytest.raises(ConstraintError):
        c.insert([{"_id": 8, "name": None}])
    with pytest.raises(ConstraintError):
        c.update(all_(), {"name": "same"})
    with pytest.raises(ConstraintError):
        c.create_index(["name"], "full_text")
    assert c.size() == 2 and c.has_index(["name"]) and [i.name for i in c.indexes()] == ["name|unique"]
    c.rebuild_index(["name"])
    c.drop_index(["name"])
    assert not c.indexes() and c.insert([{"_id": 9, "name": "a"}]) == [9]


def test_unique_array_elements(db):
    c = db.collection("arrays")
    c.insert([{"_id": 1, "tags": ["x", "y"]}, {"_id": 2, "tags": ["y", "z"]}])
    with pytest.raises(ConstraintError):
        c.create_index(["tags"], "unique")


def test_full_text_index_is_needed(db):
    c = db.collection("docs")
    c.insert([{"body": "quick fox"}])
    with pytest.raises(FilterError):
        c.find(field_("body").text("fox"))
    c.create_index(["body"], "full_text")
    assert c.find(field_("body").text("fox")).count() == 1


def test_processors_run_in_order(db):
    c = db.collection("p")
    c.add_processor(lambda d: d.withColumn("v", F.col("v") + 1), lambda d: d.withColumn("v", F.col("v") * 10))
    c.add_processor(lambda d: d.withColumn("v", F.col("v") * 2), None)
    c.insert([{"v": 1}])
    assert c.find().first()["v"] == 40 and c.raw().first()["v"] == 4


def test_transactions(db):
    db.collection("a").insert([{"_id": 1, "v": 1}])
    with db.transaction() as t:
        t.collection("a").insert([{"_id": 2, "v": 2}])
        t.collection("b").insert([{"_id": 3, "v": 3}])
        assert db.collection("a").size() == 1 and t.collection("a").size() == 2
    assert db.collection("a").size() == 2 and db.collection("b").size() == 1
    with pytest.raises(ZeroDivisionError), db.transaction() as t:
        t.collection("a").remove(all_())
        raise ZeroDivisionError
    assert db.collection("a").size() == 2 and t.state == "rolled back"
    late = db.transaction()
    late.collection("a").clear()
    db.collection("a").insert([{"_id": 4, "v": 4}])
    with pytest.raises(Conflict):
        late.commit()
    assert late.state == "failed"
    assert db.collection("a").size() == 3


def test_two_writers(spark, db):
    """A write that met another one is done again on the newest version, constraints included."""
    other = Database(spark, db.root)
    db.collection("a").create_index(["v"], "unique")
    db.collection("a").insert([{"v": 1}])
    other.collection("a").insert([{"v": 2}])
    db.collection("a").update(field_("v").eq(2), {"v": 3})
    assert other.collection("a").remove(field_("v").eq(1)) == 1
    with pytest.raises(ConstraintError):
        Database(spark, db.root).collection("a").insert([{"v": 3}])
    db.refresh()
    assert [r["v"] for r in db.collection("a").find().collect()] == [3]
    assert {r["kind"]: r["count"] for r in db.change_log().groupBy("kind").count().collect()} == {"insert": 2, "update": 1, "remove": 1}


def test_compaction_keeps_what_others_wrote(spark, db):
    """A stale handle compacts: parts of later versions stay, staged ones are protected by their age, old ones go with their manifests."""
    db.collection("a").insert([{"_id": 1}])
    stale = Database(spark, db.root)
    db.collection("a").insert([{"_id": 2}])
    t = db.transaction()
    t.collection("a").insert([{"_id": 3}])
    stale.compact()
    assert stale.collection("a").size() == 2 and len(stale.collection("a").meta.parts) == 1
    db.refresh()
    assert db.collection("a").size() == 2 and len(db.files.names("data")) == 4
    db.compact(keep=1, grace_s=0)
    assert len(db.files.names("data")) == 1 and len(db._versions()) == 1 and Database(spark, db.root).collection("a").size() == 2


def test_writers_that_are_lost(spark, db):
    """Before the manifest is in its place nothing happened; after it, whoever opens the database delivers the events."""
    c = db.collection("a")
    c.insert([{"_id": 1}])
    (stream := db.files.fs.create(db.files.path(f"manifest/{db.version + 1:020d}.json.x.tmp"), True)).close()
    assert Database(spark, db.root).collection("a").size() == 1
    real, db._deliver = db._deliver, lambda: None
    c.insert([{"_id": 2}])
    assert db.change_log().count() == 1
    again = Database(spark, db.root)
    assert again.change_log().count() == 2 and Database(spark, db.root).change_log().count() == 2
    db._deliver = real
    db.refresh()
    c.insert([{"_id": 3}])
    assert db.change_log().count() == 3 and stream is not None


def test_inner_documents_grow(db):
    c = db.collection("a")
    assert db.change_log().count() == 0
    c.insert([{"_id": 1, "at": {"city": "x"}, "tags": []}])
    c.insert([{"_id": 2, "at": {"zip": 5, "geo": {"lat": 1.5}}, "tags": ["t"]}])
    c.insert([{"_id": 3, "at": {"geo": {"lon": 2.5}}}])
    rows = {r["_id"]: r.asDict(recursive=True) for r in c.find().collect()}
    assert rows[1]["at"] == {"city": "x", "zip": None, "geo": None} and rows[2]["at"] == {"city": None, "zip": 5, "geo": {"lat": 1.5, "lon": None}}
    assert rows[3]["at"]["geo"] == {"lat": None, "lon": 2.5} and (rows[1]["tags"], rows[2]["tags"], rows[3]["tags"]) == ([], ["t"], None)
    assert [r["_id"] for r in c.find(field_("at.geo.lat").eq(1.5)).collect()] == [2]


def test_values_of_several_kinds(db):
    """One field with integers, floats, texts, booleans, lists, documents and null, as they come and in one batch."""
    c = db.collection("a")
    c.insert([{"_id": 1, "v": None, "n": 1}])
    c.insert([{"_id": 2, "v": 7, "n": 2}])
    assert c.raw().schema["v"].dataType.simpleString() == "bigint"
    c.insert([{"_id": 3, "v": 1.5}, {"_id": 4, "v": 7.0}])
    c.insert([{"_id": 5, "v": "x"}, {"_id": 6, "v": True}, {"_id": 7, "v": [1, 7]}, {"_id": 8, "v": {"in": {"side": 3}}}, {"_id": 9, "v": 5, "n": 3}])
    ids = lambda node, *sort: [r["_id"] for r in (c.find(node, *sort) if sort else c.find(node, order_by("_id"))).collect()]
    v = field_("v")
    assert ids(v.eq(7)) == [2, 7] and ids(v.eq(7.0)) == [4] and ids(v.eq("x")) == [5] and ids(v.eq(None)) == [1] and ids(v.eq(True)) == [6]
    assert ids(v.gte(7).and_(v.lte(7.0))) == [2, 4] and ids(v.lt(7).and_(v.gt(1))) == [3, 9] and ids(v.gte(7.0).and_(v.lt(100))) == [4]
    assert ids(v.in_array([7, "x"])) == [2, 5, 7] and 1 in ids(v.not_in_array([7])) and ids(v.text_regex("^x$")) == [5]
    assert ids(field_("v.in.side").eq(3)) == [8] and ids(field_("n").gte(2)) == [2, 9]
    assert ids(v.gt(0).and_(v.lt(8)), order_by("v")) == [3, 9, 2, 4]
    c.create_index(["n", "v"], "non_unique")
    assert c.update(field_("_id").eq(2), {"n": "two"}) == 1 and ids(field_("n").eq("two")) == [2] and ids(field_("n").eq(1)) == [1]
    c.create_index(["v"], "unique")
    for same in (7.0, "x", True):
        with pytest.raises(ConstraintError):
            c.insert([{"v": same}])
    c.insert([{"_id": 10, "v": 7.25}])
    db.compact()
    assert ids(v.eq(7.25)) == [10] and c.size() == 10


def test_text_index_follows_the_rows(spark, db):
    """What queries find by the index is what they find in the texts, after inserts, updates, removals and a compaction."""
    c = db.collection("docs")
    c.insert([{"_id": i, "body": t} for i, t in enumerate(["The quick fox", "the lazy dog and the Fox", "", None, "quick quick dog"])])
    c.create_index(["body"], "full_text")
    c.create_index(["tags"], "fts")
    c.insert([{"_id": 10, "body": "fox of the dogs", "tags": ["red fox", "dog"]}, {"_id": 11, "body": "nothing", "tags": ["fox red"]}])

    def same():
        rows = c.frame()
        for node in (field_("body").text("Fox"), field_("body").text_case_insensitive("fox"), field_("body").text("dog*"), field_("body").text("*ick"), field_("body").text("*o*"), field_("body").text("the")):
            by_scan = find(rows, node, None, Context()).select("_id").collect()
            assert sorted(r["_id"] for r in c.find(node).collect()) == sorted(r["_id"] for r in by_scan), node
        for node in (field_("body").matches("quick dog", 3), field_("body").matches("fox AND NOT the"), field_("body").phrase("the lazy dog"), field_("tags").phrase("red fox"), field_("body").matches("dog OR NOT fox")):
            want = [(r["_id"], round(r["_score"] or 0, 9)) for r in find(rows, node, None, Context()).collect()]
            assert [(r["_id"], round(r["_score"] or 0, 9)) for r in c.find(node).collect()] == want, node

    same()
    c.update(field_("_id").eq(11), {"body": "a quick Fox again"})
    c.remove(field_("_id").eq(0))
    same()
    db.compact()
    same()
    assert [r["_id"] for r in c.find(field_("body").text_case_insensitive("fox")).orderBy("_id").collect()] == [1, 10, 11]


def test_text_index_options(db):
    from docspire.sources import textindex

    c = db.collection("d")
    textindex.TOKENIZERS["commas"] = lambda text: F.split(text, ",")
    c.insert([{"_id": 1, "a": "der Hund", "b": "new york,the end", "d": "alpha beta"}])
    c.create_index(["a"], "full_text", language="german")
    c.create_index(["b"], "full_text", tokenizer="commas")
    c.create_index(["d"], "full_text", stop_words=["alpha"])
    n = lambda path, word: c.find(field_(path).text(word)).count()
    assert (n("a", "der"), n("a", "Hund"), n("b", "york"), n("d", "alpha"), n("d", "beta")) == (0, 1, 0, 0, 1)
    assert c.index_tables(["b"]).postings().filter("term = 'new york'").count() == 1


def test_text_index_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Each task sorts its own rows by runs: the places of every token, long rows and null tokens and keys included."""
    from docspire.sources import textindex

    texts = ["Fox the fox THE the", "", None, "of the " * 40, " ".join(f"w{i % 7} Ünï" for i in range(30)), "fox"]
    monkeypatch.setattr(textindex, "RUN_TOKENS", 8)
    monkeypatch.setattr(textindex, "RUN_ROWS", 3)
    monkeypatch.setitem(textindex.TOKENIZERS, "with_nulls", lambda c: F.transform(F.split(c, " "), lambda t: F.when(t != "the", t)))
    rows = spark.createDataFrame([(i if i < 5 else None, t) for i, t in enumerate(texts)], "_id bigint, body string").repartition(2)
    for tokenizer, split in (("words", lambda t: t.split()), ("with_nulls", lambda t: [None if w == "the" else w for w in t.split(" ")])):
        folder = str(tmp_path / tokenizer)
        textindex.TextIndex.build(rows, "body", "_id", folder, tokenizer)
        index = textindex.TextIndex(spark, [folder], tokenizer=tokenizer)
        want = set()
        for i, words in enumerate(split(t) for t in texts if t is not None):
            key = [0, 1, 3, 4, None][i]
            want |= {(w.lower(), w, key, len(words), tuple(p for p, x in enumerate(words) if x == w)) for w in words if w is not None}
        got = [(r["low"], r["term"], r["key"], r["n"], tuple(r["at"])) for r in index.postings().collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        stats = index.stats().first()
        sizes = [len(split(t)) for t in texts if t is not None and split(t)]
        assert stats["rows"] == len(sizes) and abs(stats["mean"] - sum(sizes) / len(sizes)) < 1e-9
        assert [f.name for f in (tmp_path / tokenizer / "postings").iterdir() if f.is_dir()] == []

    batches = [pa.record_batch([pa.array(range(4)), pa.array([["b", "a"] * 3, ["c"] * 20, None, ["a"]])], names=["key", "ts"])]
    runs = list(textindex._runs(8, 3)(iter(batches)))
    assert sum(b.num_rows for b in runs) == 3 + 4 and sum(len(x) for b in runs for x in b.column("at").to_pylist() if x) == 27


def test_wildcards_join_no_postings(spark, tmp_path, monkeypatch):
    """A search with wildcards tests the postings themselves, however many terms it finds."""
    from docspire.sources import textindex

    rows = spark.createDataFrame([(i, f"w{i} Wx{i % 3} the other") for i in range(40)] + [(40, None), (41, "none")], "_id bigint, body string")
    textindex.TextIndex.build(rows, "body", "_id", str(tmp_path / "index"))
    index = textindex.TextIndex(spark, [str(tmp_path / "index")], frozenset(["the"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for listed in (0, 5, 1000):
            monkeypatch.setattr(textindex, "LISTED_TERMS", listed)
            for query, want in (("w*", set(range(40))), ("*x2", set(range(2, 40, 3))), ("*3*", {3, 13, 23, *range(30, 40)}), ("*the", set()), ("*he*", set(range(40))), ("*q*", set())):
                found = index.term(query)
                keys = [r["key"] for r in found.collect()]
                assert len(keys) == len(set(keys)) and set(keys) == want, (listed, query)
                assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert textindex.TextIndex(spark, []).term("*a").count() == 0


def test_places_are_read_once(spark, tmp_path):
    """Boolean searches and phrases read and shuffle the places of words once; their statistics need none."""
    from docspire.plans import textquery
    from docspire.sources.textindex import TextIndex

    texts = ["tion Tion thing", "tion", "TION other", "thing tion", None]
    TextIndex.build(spark.createDataFrame(list(enumerate(texts)), "_id bigint, body string"), "body", "_id", str(tmp_path / "index"))
    found = TextIndex(spark, [str(tmp_path / "index")]).matches(textquery.parse("tion AND NOT thing"))
    assert {r["key"] for r in found.collect()} == {1, 2}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 2  # two words


def test_vector_cells_and_layouts(spark):
    """A vector index beside each part, rows laid out by place, and a module that registers an indexer."""
    from docspire.sources import indexers

    db = Database.temporary(spark)
    c = db.collection("v")
    vectors = [[float((i * j) % 13 - 6) for j in range(1, 9)] for i in range(1, 121)]
    c.insert([{"_id": i, "e": v, "at": {"x": float(i % 11), "y": float(i % 7)}} for i, v in enumerate(vectors[:80])])
    c.create_index(["e"], "vector_cells", metric="euclidean", probes=1000)
    c.create_index(["at"], "spatial")
    c.insert([{"_id": 80 + i, "e": v, "at": {"x": -1.0, "y": 2.0}} for i, v in enumerate(vectors[80:])])
    node = field_("e").nearest(vectors[5], 6, "euclidean")
    want = [(r["_id"], round(r["_score"], 9)) for r in find(c.frame(), node).collect()]
    assert [(r["_id"], round(r["_score"], 9)) for r in c.find(node).collect()] == want
    c.rebuild_index(["at"])
    assert c.size() == 120 and len(c.meta.parts) == 1 and c.find(field_("at").near(-1.0, 2.0, 0.5)).count() == 40
    opened = []
    db.load(lambda d: indexers.register("mine", indexers.Indexer("text", lambda *_: None, lambda *a: opened.append(a))))
    c.create_index(["note"], "mine")
    assert c.find().count() == 120 and opened
    with pytest.raises(ValueError):
        indexers.register("mine", indexers.INDEXERS["fts"])
    del indexers.INDEXERS["mine"]


def test_documents():
    from docspire.functions import documents as D

    d = {"_id": 1, "a": {"b": {"c": 1}, "k": [1]}, "x.y": 2}
    D.put(d, "a.b.d.e", 3)
    assert (D.get(d, "a.b.d.e"), D.get(d, "x.y"), D.get(d, "a.z.b")) == (3, 2, None)
    assert sorted(D.fields(d)) == ["a.b.c", "a.b.d.e", "a.k", "x.y"] and D.contains_field(d, "a.k") and not D.contains_field(d, "a.b")
    D.remove(d, "a.b.d.e")
    D.remove(d, "a.b.c")
    assert d["a"] == {"k": [1]} and not D.contains_key(d["a"], "b")
    D.merge(d, {"a": {"k": [2], "n": {"m": 1}}, "x.y": None})
    assert d == {"_id": 1, "a": {"k": [2], "n": {"m": 1}}, "x.y": None} and D.pretty({"a": 1}) == '{\n  "a": 1\n}'


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_vector_index(spark, tmp_path, metric):
    """Recall of the default probes, and the exact result with all of them."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    folder = str(tmp_path / "ivf")
    VectorIndex.build(rows, "embedding", "vec_id", folder, metric)
    index = VectorIndex(spark, folder, metric)
    queries = [tuple(r["embedding"]) for r in rows.filter("vec_id % 29 = 3").limit(12).collect()]
    assert len(index.centres) > 10 and index.recall(rows, "embedding", "vec_id", queries, 10) >= 0.9
    exact = [(r["vec_id"], round(r["_score"], 9)) for r in nearest(rows, "embedding", queries[0], 10, metric, None, "vec_id").collect()]
    assert [(r["key"], round(r["_score"], 9)) for r in index.nearest(queries[0], 10, probes=len(index.centres)).collect()] == exact
    VectorIndex.build(rows.limit(0), "embedding", "vec_id", folder + "0", metric)
    assert VectorIndex(spark, folder + "0", metric).nearest(queries[0], 3).count() == 0


def test_catalog(db):
    db.collection("a").insert([{"v": 1}])
    db.collection("a").insert([{"v": 2}])
    db.collection("a").set_attributes({"owner": "me"})
    assert db.list_collections() == ["a"] and db.collection("a").attributes() == {"owner": "me"}
    db.compact()
    assert len(db.collection("a").meta.parts) == 1 and db.collection("a").size() == 2
    with pytest.raises(ValueError):
        db.collection("bad name")
    db.destroy("a")
    assert db.list_collections() == [] and db.metadata()["schema_version"] == 1


def test_migrations(db):
    c = db.collection("m")
    c.insert([{"_id": 1, "old": "5", "junk": 1}])
    steps = M.Migration(1, 2).on("m", M.RenameField("old", "new"), M.ChangeDataType("new", lambda x: x.cast("int")), M.AddField("flag", True), M.DeleteField("junk"), M.CreateIndex("unique", ["new"]))
    more = M.Migration(2, 4).on("m", M.Rename("renamed"))
    db.migrate([steps, more, M.Migration(2, 3)], 4)
    row = db.collection("renamed").find().first()
    assert (row["new"], row["flag"]) == (5, True) and "junk" not in row.asDict() and db.collection("renamed").has_index(["new"])
    assert db.state["schema_version"] == 4 and not db.has_collection("m")
    db.collection("taken").insert([{"_id": 5}])
    with pytest.raises(ConstraintError):
        db.migrate([M.Migration(4, 5).on("renamed", M.Rename("taken"))], 5)
    assert db.collection("taken").get_by_id(5) and db.collection("renamed").size() == 1
    with pytest.raises(ValueError):
        M.path([steps], 1, 9)


@dataclass
class Isbn:
    code: str
    edition: int


@entity(id_field="isbn", embedded=("code", "edition"), indexes=(("non_unique", ("publisher",)),))
@dataclass
class Book:
    isbn: Isbn
    publisher: str
    price: float


def test_repository(db):
    r = Repository(db, Book)
    r.insert(Book(Isbn("a", 1), "p", 1.5), Book(Isbn("a", 2), "q", 2.5))
    assert r.get_by_id(Isbn("a", 2)).price == 2.5 and r.get_by_id(Isbn("z", 2)) is None
    with pytest.raises(ConstraintError):
        r.insert(Book(Isbn("a", 1), "again", 0.0))
    with pytest.raises(ConstraintError):
        r.insert(Book(None, "no id", 0.0))
    assert r.update(Book(Isbn("a", 1), "p", 9.0)) == 1 and r.get_by_id(Isbn("a", 1)).price == 9.0
    assert r.remove(Book(Isbn("a", 1), "p", 9.0)) == 1 and r.size() == 1
    assert db.list_repositories() == ["Book"] and Repository(db, Book, "key").size() == 0
    assert db.list_keyed_repositories() == {"key": ["Book"]}


@entity(id_field="row", generated=True)
@dataclass
class Note:
    row: int | None
    text: str
    by: Isbn | None = None


def test_generated_ids_and_joined_entities(db):
    """Ids that the store gives, entities inside entities, and a join of two repositories."""
    notes, books = Repository(db, Note), Repository(db, Book)
    first = Note(None, "one", Isbn("a", 1))
    ids = notes.insert(first, Note(None, "two"))
    assert first.row == ids[0] and notes.get_by_id(ids[0]) == first and notes.get_by_id(ids[1]).by is None
    with pytest.raises(ConstraintError):
        notes.insert(Note(5, "own id"))
    books.insert(Book(Isbn("a", 1), "p", 1.5), Book(Isbn("a", 2), "q", 2.5))
    joined = notes.join(notes.find(), books.find(), "by.code", "isbn.code", "books").orderBy("_id").collect()
    assert [len(r["books"] or []) for r in joined] == [2, 0]
    pairs = cursor.lookup_rows(notes.find(), books.find(), "by.code", "isbn.code", "book").orderBy("_id", "book.isbn.edition").collect()
    assert [(r["text"], r["book"] and r["book"]["publisher"]) for r in pairs] == [("one", "p"), ("one", "q"), ("two", None)]
    assert [i for i, _ in cursor.iter_with_id(notes.find(None, order_by("_id")))] == ids
    assert [i for i, _ in cursor.iter_with_id(notes.find().select("text"))] == [0, 1]


def test_database_handle(db):
    c = db.collection("a")
    seen = []
    c.subscribe(lambda e: seen.append((e["kind"], e["rows"] and e["rows"].count())))
    assert not db.is_closed() and not db.has_unsaved_changes() and db.config()["separator"] == "."
    c.insert([{"_id": 1, "v": 1}, {"_id": 2, "v": 2}])
    c.create_index(["v"], "non_unique")
    assert c.update_with_ids(field_("v").gte(1), {"w": 1}) == [1, 2] and c.update_with_ids(field_("v").gte(1), {"w": 2}, just_once=True) == [1]
    with db.transaction() as t:
        t.collection("a").insert([{"_id": 3}])
        assert t.db.has_unsaved_changes()
    assert seen == [("insert", 2), ("index_start", None), ("index_end", None), ("update", 2), ("update", 1), ("insert", 1)]
    c.dispose()
    db.close()
    assert db.is_closed() and not db.has_collection("a")
    with pytest.raises(RuntimeError):
        c.insert([{"_id": 4}])


def test_rag_store(db):
    s = RagStore(db.collection("rag"), 2)
    assert s.is_empty()
    s.add_many([("one", [1.0, 0.0], {"source": "x"}), ("two", [0.0, 1.0], {"source": "y"}), ("three", [0.9, 0.1], {"source": "y"})])
    assert [r["text"] for r in s.search([1.0, 0.0], 2).filter(field_("source").eq("y")).run().collect()] == ["three", "two"]
    assert [r["text"] for r in s.search([1.0, 0.0], 5).min_score(0.5).run().collect()] == ["one", "three"] and len(s) == 3
    with pytest.raises(ValueError):
        s.add("bad", [1.0])


def test_change_stream(spark, db, tmp_path):
    db.collection("c").insert([{"_id": 1, "v": 1}])
    got = []
    run = lambda: changes.subscribe(spark, f"{db.root}/changes", lambda batch, _: got.extend(r["kind"] for r in batch.collect()), str(tmp_path / "check")).awaitTermination(60)
    run()
    db.collection("c").remove(by_id(1))
    run()
    assert got == ["insert", "remove"]
    last = changes.latest(db.change_log()).collect()
    assert [(r["_id"], r["kind"]) for r in last] == [(1, "remove")]
