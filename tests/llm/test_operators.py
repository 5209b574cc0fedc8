"""The ten operators on awkward rows and against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from docspire.llm import bpe, common, decontaminate, html, langid, minhash, quality, queries, rollup, secrets, substrings, suffixes
from docspire.llm import repeats as R

TABLES = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def rows_by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def corpus(seed, n=60):
    """Texts that share passages, with copies and edits of edits."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(45)]
    texts, family = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            family = list(family)
            for _ in range(rng.randrange(1, 4)):
                family[rng.randrange(len(family))] = rng.choice(vocabulary)
            texts.append(" ".join(family))
        elif kind == 1:
            cut = rng.randrange(len(passage) - 25)
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
            texts.append("\n".join([" ".join(own), " ".join(passage[cut:]), " ".join(own[:7])]))
        elif kind == 2:
            texts.append(texts[rng.randrange(len(texts))] if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))))
        else:
            texts.append(" ".join(["again"] * rng.randrange(60)))
    return texts


@pytest.fixture(scope="module")
def texts(spark):
    made = corpus(3)
    return made, spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").repartition(3)


# 1
def test_language_id(spark, documents):
    train = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("кошка и собака", "ru")] * 60)]
    df = spark.createDataFrame(train, "doc_id bigint, text string, lang string, source string")
    model = langid.fit(df)
    mixed = spark.createDataFrame([(1, "the dog and the cat der hund und die katze und der hund"), (2, "собака"), (3, "123 ..."), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.predict(mixed, model, switch=2.0).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and got[1]["lang_pred"] == "de"
    assert got[2]["lang_pred"] == "ru" and got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[4]["score"] == 0
    out = langid.language_id(documents).collect()
    assert len(out) == documents.count() and all(0 <= r["score"] <= 1 for r in out)
    empty = langid.language_id(documents.limit(0))
    assert empty.count() == 0
    assert langid.language_id(documents.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_language_is_learnt_from_rows_not_held_out(spark):
    df = spark.range(200).selectExpr("id doc_id", "'aaa' text", "if(pmod(crc32(string(id)), 4) = 2, 'xx', 'yy') lang", "'s' source")
    assert {r["lang_pred"] for r in langid.language_id(df).collect()} == {"yy"}


def test_viterbi_is_the_best_path():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = np.array([4, 1, 6, 3])
    scores = rng.normal(size=(14, 3)).astype("f4") * 3
    got = langid._viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        part = scores[at : at + n]
        value = lambda path: sum(part[t, s] for t, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
        assert abs(value(tuple(got[at : at + n])) - best) < 1e-4
        at += n


def test_language_against_brute_force(spark, documents):
    """Every word's scores by loops over its letters, narrowed by its script, and the best path by trying all of two states a step."""
    import numpy as np

    train = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog ran", "en"), ("der hund und die katze lief", "de"), ("кошка и собака бежит", "ru")] * 20)]
    model = langid.fit(spark.createDataFrame(train, "doc_id bigint, text string, lang string, source string"))
    texts = ["the dog und die katze", "кошка cat и der hund", "x", "Und THE Hund; dog-cat 12 собака", "日本 the"]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, 1.5).collect()}
    langs = model["langs"]
    for i, text in enumerate(texts):
        begin, starts, ends, _, two, three, script = langid._runs([text])
        at, rows = 0, []
        for a, b, kind in zip(starts, ends, script, strict=True):
            row = []
            for k in range(len(langs)):
                total = sum(float(model["two"][two[at + j], k]) + float(model["three"][three[at + j], k]) for j in range(b - a))
                row.append(total if model["written"][kind, k] else total - 1e4)
            rows.append(row)
            at += b - a
        value, paths = np.array(rows[0]), [[k] for k in range(len(langs))]
        for row in rows[1:]:
            best = [max(range(len(langs)), key=lambda s, k=k: value[s] - 1.5 * (s != k)) for k in range(len(langs))]  # noqa: B023
            paths = [paths[s] + [k] for k, s in enumerate(best)]
            value = np.array([value[s] - 1.5 * (s != k) + row[k] for k, s in enumerate(best)])
        path = paths[int(value.argmax())]
        mass = collections.Counter()
        for k, a, b in zip(path, starts, ends, strict=True):
            mass[langs[k]] += int(b - a)
        assert got[i]["lang_pred"] == max(sorted(mass), key=mass.get), text
        assert abs(got[i]["score"] - max(mass.values()) / sum(mass.values())) < 1e-9
        spans = [(langs[k], int(a - begin[0]), int(b - begin[0])) for k, a, b in zip(path, starts, ends, strict=True)]
        runs = [list(g) for _, g in itertools.groupby(spans, key=lambda x: x[0])]
        merged = [(g[0][0], g[0][1], g[-1][2]) for g in runs]
        assert [(s["lang"], s["start"], s["end"]) for s in got[i]["spans"]] == merged


def test_language_accuracy(spark):
    """Of rows that were not learnt from."""
    rows = spark.read.parquet(f"{TABLES}/documents.parquet")
    held = langid.language_id(rows).filter("held_out").join(rows.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


# 2
def brute_components(texts, k):
    sets = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k,block", [(2, 1000), (5, 4)])
def test_minhash(texts, monkeypatch, k, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    made, df = texts
    want, sizes = brute_components(made, k)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k).collect()}
    assert [got[i]["component_id"] for i in range(len(made))] == want
    assert [got[i]["n_shingles"] for i in range(len(made))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_minhash_family_of_edits(spark, monkeypatch):
    """A walk of edits: most members are far from the first, so the rest of each bucket matters."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(1)
    family, made = [f"x{i}" for i in range(80)], []
    for _ in range(40):
        for _ in range(4):
            family[rng.randrange(80)] = f"y{rng.randrange(50)}"
        made.append(" ".join(family))
    rng.shuffle(made)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    want, _ = brute_components(made, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert [got[i] for i in range(len(made))] == want


def test_minhash_awkward(documents):
    got = rows_by_id(minhash.near_duplicates(documents, 2))
    assert sum(map(len, got.values())) == documents.count()
    assert got[2][0]["component_id"] == 1 and not got[2][0]["kept"] and got[3][0]["component_id"] == 1
    assert got[4][0]["n_shingles"] == 0 and got[4][0]["component_id"] == 4 and got[6][0]["kept"] and got[7][0]["n_shingles"] == 1
    assert len(got[7]) == 2 and got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert minhash.near_duplicates(documents.limit(0), 2).count() == 0


def test_minhash_of_shared_ids(spark):
    """Rows of one id are judged by their own texts, whatever the partitioning."""
    rows, df = shared_ids(spark)
    known = [(i, t) for i, t in rows if i is not None]
    component, sizes = brute_components([t for _, t in known], 2)
    least = {}
    for (i, _), c in zip(known, component, strict=True):
        least[c] = min(i, least.get(c, i))
    want = collections.Counter((i, n, least[c], least[c] == i) for (i, _), c, n in zip(known, component, sizes, strict=True))
    for parts in (1, 5):
        got = minhash.near_duplicates(df.repartition(parts), 2).collect()
        assert collections.Counter(tuple(r) for r in got if r["doc_id"] is not None) == want
        assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None) and len(got) == len(rows)


def test_blocks_send_one_link_for_two_roots():
    """Strays similar to every member of a group, and to each other, cost a link each and not one for each pair."""
    import pyarrow as pa

    text = lambda i: " ".join([f"w{j}" for j in range(80)] + [f"own{i}"])
    rows = [(9, 0, i, 500, 0, text(i)) for i in range(60)] + [(9, 1, 100 + i, 600 + i, 1, text(100 + i)) for i in range(5)] + [(9, 1, 200, 700, 1, "nothing alike at all")]
    names = ["block", "side", "rep", "root", "share", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(6)], names)
    links = minhash._block_links([batch], 2, 80).to_pylist()
    assert len(links) == 5 and {x["b"] for x in links} == {100, 101, 102, 103, 104}
    rows = [(9, 2, i, i % 7, i % 2, text(i)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(6)], names)
    links = minhash._block_links([batch], 2, 80).to_pylist()
    parent = {r: r for r in range(7)}
    for x in links:
        a, b = parent[x["a"] % 7], parent[x["b"] % 7]
        parent = {r: a if p == b else p for r, p in parent.items()}
    assert len(links) == 6 and len(set(parent.values())) == 1


def test_minhash_group_and_strays(spark, monkeypatch):
    """A group of near copies and strays of the same buckets: the rows dealt grow with the group, not with its square."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "HEAVY", 50)
    base = [f"w{j}" for j in range(60)]
    texts = [" ".join(base[:30] + [f"copy{i}"] + base[31:]) for i in range(200)] + [" ".join([f"s{i}x{j}" for j in range(60)]) for i in range(3)]
    # All sets share a bucket, as if one band of the strays met the group's.
    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda rows, k: real(rows, k).withColumn("bands", F.concat(F.array(F.lit(1).cast("bigint")), "bands")))
    dealt, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda d, *rest: dealt.append(d.count()) or links(d, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {i: 0 if i < 200 else i for i in range(203)}
    # At most a row for each band and member, and a hub for each block; then the group once, against the strays.
    assert len(dealt) == 2 and dealt[0] < 4 * 203 and dealt[1] < 1.2 * 203


# 3 and 4
def brute_words(items, window):
    seen, out = set(), {}
    for i, t in sorted(items):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(items, length):
    seen, out = set(), {}
    for i, t in sorted(items):
        raw = (t or "").encode()
        gone, new = bytearray(len(raw)), set()
        for s in range(len(raw) - length + 1):
            key = raw[s : s + length]
            if key in seen:
                gone[s : s + length] = b"\1" * length
            new.add(key)
        seen |= new
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for s in range(len(raw)) if gone[s] and (s == 0 or not gone[s - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_rows(rows, size, tokens, pieces, same_document):
    """Removed tokens of rows that may share an id; rows without id are compared with none."""
    first = {}
    for i, t in rows:
        ts = tokens(t)
        for s in range(len(ts) - size + 1) if i is not None else ():
            place = (i, s if same_document else 0)
            first[pieces(ts[s : s + size])] = min(place, first.get(pieces(ts[s : s + size]), place))
    out = collections.Counter()
    for i, t in rows:
        ts = tokens(t)
        gone = [False] * len(ts)
        for s in range(len(ts) - size + 1) if i is not None else ():
            if first[pieces(ts[s : s + size])] < (i, s if same_document else 0):
                gone[s : s + size] = [True] * size
        out[i, len(ts), sum(gone), tuple(k for k, g in zip(ts, gone, strict=True) if not g)] += 1
    return out


def shared_ids(spark):
    """Rows of one id and different texts, the longer and the shorter first, rows of equal texts, rows without id."""
    made = corpus(9)
    rows = [(None if i % 11 == 0 else i // 3 if i % 5 else 4, t) for i, t in enumerate(made)] + [(4, made[0] + " " + made[5]), (4, made[5]), (70, made[5]), (70, made[5])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def longest_run(rows):
    """For each text the number of words of its longest run that starts at two places."""
    runs = collections.defaultdict(set)
    for i, (_, t) in enumerate(rows):
        w = words(t)
        for s in range(len(w)):
            for e in range(s + 20, len(w) + 1):
                runs[tuple(w[s:e])].add((i, s))
    best = collections.Counter()
    for run, places in runs.items():
        for i, _ in places if len(places) > 1 else ():
            best[i] = max(best[i], len(run))
    return best


def test_substrings(spark, texts, documents):
    made, df = texts
    found = substrings.dedup(df).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found}
    want = brute_words(list(enumerate(made)), 20)
    assert got == want and sum(v[1] for v in want.values())
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", "text").distinct()
    want = brute_words([(r["doc_id"], r["text"]) for r in known.collect()], 20)
    got = rows_by_id(substrings.dedup(documents))
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[i] for i, rs in got.items() if i is not None for r in rs)
    assert len(got[7]) == 2 and got[None][0]["n_removed"] == 0
    assert substrings.dedup(documents.limit(0)).count() == 0


def test_substrings_of_shared_ids(spark):
    rows, df = shared_ids(spark)
    want = brute_rows(rows, 20, lambda t: (t or "").encode().split(), tuple, True)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], tuple(bytes(r["kept"]).split())) for r in substrings.dedup(df).collect())
    assert got == want


def test_substring_levels(spark):
    """The doubling goes on until nothing repeats, and its last level brackets the longest repeat."""
    rng = random.Random(4)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    shared = fill(700)
    rows = [(i, " ".join(fill(rng.randrange(30)) + shared[:n] + fill(rng.randrange(30)))) for i, n in enumerate((0, 15, 20, 39, 45, 80, 90, 160, 200, 350, 700, 700))]
    best = longest_run([(i, t) for i, t in rows])
    got = {r["doc_id"]: r["repeat_level"] for r in substrings.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_text=False).collect()}
    for i, _ in rows:
        assert got[i] <= best[i] < 4 * got[i] if best[i] else got[i] == 0, (i, got[i], best[i])
    assert got[10] == got[11] >= 320 and got[4] == 20


@pytest.mark.parametrize("ranges", [suffixes.MOST_RANGES, 7])
def test_suffixes(texts, documents, ranges, monkeypatch):
    if ranges == 7:
        monkeypatch.setattr(R, "FLUSH", 150)  # strings in many parts
        monkeypatch.setattr(suffixes, "MOST_RANGES", 7)
    made, df = texts
    shown = lambda r: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    want = brute_bytes(list(enumerate(made)), 50)
    assert {r["doc_id"]: shown(r) for r in suffixes.dedup(df).collect()} == want and sum(v[1] for v in want.values())
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", "text").distinct()
    want = brute_bytes([(r["doc_id"], r["text"]) for r in known.collect()], 50)
    got = rows_by_id(suffixes.dedup(documents))
    assert all(shown(r) == want[i] for i, rs in got.items() if i is not None for r in rs)
    assert got[None][0]["n_removed"] == 0 and suffixes.dedup(documents.limit(0)).count() == 0


def test_suffixes_of_shared_ids(spark):
    rows, df = shared_ids(spark)
    want = brute_rows(rows, 50, lambda t: list((t or "").encode()), bytes, False)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], tuple(bytes(r["kept"]))) for r in suffixes.dedup(df).collect())
    assert got == want


def test_splitters(monkeypatch):
    """Ranges are in byte order, equal tokens share one, and a token that fills several is hot."""
    import numpy as np

    rng = np.random.default_rng(2)
    sample = rng.integers(0, 3, (5000, 2)).astype(np.uint64)
    sample[:, 1] += rng.integers(0, 40, 5000).astype(np.uint64)
    sample[:2500] = (1, 20)
    keys = [np.ascontiguousarray(sample[:, j]) for j in range(2)]
    made = suffixes.Ranges(keys, 20)
    to = made.of(*keys)
    order = np.lexsort(keys[::-1])
    assert (np.diff(to[order]) >= 0).all() and 9 < len(set(to)) <= 20
    by_key = collections.defaultdict(set)
    for k, b in zip(map(tuple, sample.tolist()), to.tolist(), strict=True):
        by_key[k].add(b)
    assert all(len(b) == 1 for b in by_key.values()) and made.hot.tolist() == [20]
    got, new = R.multikey(keys)
    assert (sample[got] == sample[order]).all() and new.sum() == len(by_key)
    assert suffixes.Ranges([np.zeros(0, np.uint64)] * 2, 20).of(*keys).max() == 0


def whole_documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_dedup_of_whole_documents(spark):
    """Operators 2 to 4 on the 1,000 test documents, by brute force."""
    rows = whole_documents(spark)
    df = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(df, keep_text=False).collect()}
    assert got == brute_words(rows, 20)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(df).collect()}
    assert got == brute_bytes(rows, 50)
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({hash((a, b)) for a, b in itertools.pairwise(w)} if len(w) > 1 else {hash(tuple(w))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 2).collect()} == want


# 5
def test_decontamination(spark, documents):
    rng = random.Random(5)
    item = lambda n: [f"b{rng.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(item(n))) for i, n in enumerate((12, 30, 44, 60, 5))] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for i, (_, t) in enumerate(items[:5]):
        w = t.split()
        for e in (w, w[1:], w[: len(w) // 2] + ["new"] + w[len(w) // 2 :], [*w[:-1], "END"], w[: len(w) // 2]):
            docs.append((10 * i + len(docs), " ".join([*item(9), *e, *item(9)]).upper()))
    df = spark.createDataFrame([*docs, (999, None), (998, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for (d, t), (i, b) in itertools.product(docs, items):
        own = shingles(words((b or "").lower()))
        every = shingles(words(t.lower()))
        m = len(own)
        for s in range(max(1, len(every) - m + 1)) if m else ():
            shared = sum((collections.Counter(own) & collections.Counter(every[s : s + m])).values())
            union = m + len(every[s : s + m]) - shared
            if 100 * shared >= 80 * union:
                want[d, i] = max(want.get((d, i), 0), round(shared / union, 6))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want and len(want) > 8
    assert decontaminate.contaminated(documents, bench.limit(0)).count() == 0 and decontaminate.contaminated(documents.limit(0), bench).count() == 0
    own = documents.filter("doc_id = 1").selectExpr("1L item_id", "text")
    assert {r["doc_id"] for r in decontaminate.contaminated(documents, own).collect()} >= {1, 2, 9}


def test_decontamination_of_moved_parts(spark):
    """Items whose parts stand in another order, however far those moved, and items cut in lines."""
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(9000)}" for _ in range(n)]
    sizes = (45, 59, 100, 200)
    items = [[f"i{i}x{j}" for j in range(n)] for i, n in enumerate(sizes)]
    moved = [(w[k:] + w[:k]) for w in items for k in (10, 20, len(w) // 2)]
    moved.append([x for part in range(0, 200, 50) for x in items[3][150 - part : 200 - part]])
    docs = [(i, " ".join([*fill(30), *w, *fill(30)])) for i, w in enumerate(moved)]
    docs += [(100 + i, "\n".join(w)) for i, w in enumerate(moved)]
    want = {}
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    for (d, t), (i, w) in itertools.product(docs, enumerate(items)):
        own, every = shingles(w), shingles(words(t))
        m = len(own)
        for s in range(max(1, len(every) - m + 1)):
            part = every[s : s + m]
            shared = sum((collections.Counter(own) & collections.Counter(part)).values())
            union = m + len(part) - shared
            if 100 * shared >= 80 * union:
                want[d, i] = max(want.get((d, i), 0), round(shared / union, 6))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == want and len(want) > 16


def test_decontamination_of_short_and_long_items(spark):
    """Items below a shingle by their whole word sequence; one of 1,500 words, moved parts and all."""
    rng = random.Random(11)
    fill = lambda n: [f"g{rng.randrange(9000)}" for _ in range(n)]
    long = [f"l{j}" for j in range(1500)]
    docs = [(1, "Alpha beta, and alpha BETA"), (2, "alpha then beta"), (3, " ".join(fill(40) + long[750:] + long[:750] + fill(40))), (4, " ".join(long[:600])), (5, None), (6, "solo")]
    items = [(1, "alpha beta"), (2, " ".join(long)), (3, "Solo"), (4, ""), (5, None), (6, "nowhere at all")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in found if r["item_id"] != 2} == {(1, 1, 3), (6, 3, 0)}
    assert [(r["doc_id"], r["similarity"] > 0.99) for r in found if r["item_id"] == 2] == [(3, True)]


def test_decontamination_of_shared_ids(spark):
    item = " ".join(f"i{j}" for j in range(30))
    rows = [(7, "clean words of a document that holds nothing"), (7, "before " + item), (None, item), (8, "clean"), (8, "clean")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {(r["doc_id"], r["start"], r["similarity"]) for r in found.collect()} == {(7, 1, 1.0), (None, 0, 1.0)}


def test_multi_index_finds_all_within_the_radius(spark):
    """Every fingerprint within the radius, and few beside."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(60)]
    flip = lambda x, n: ((x % 2**64) ^ sum(1 << b for b in rng.sample(range(64), n))) % 2**64
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    asked = [(i, signed(flip(x, n))) for i, x in enumerate(prints) for n in (0, 5, 12, 14, decontaminate.RADIUS)]
    a = spark.createDataFrame(asked, "i int, p bigint").select("i", "p", F.explode(decontaminate._blocks(F.col("p"))).alias("b")).select("i", "p", "b.*")
    b = spark.createDataFrame(list(enumerate(prints)), "j int, q bigint").select("j", F.explode(decontaminate._blocks(F.col("q"))).alias("b")).select("j", "b.*")
    b = b.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, decontaminate._nearby())), lambda x: x.cast("bigint").bitwiseXOR(F.col("value")))))
    pairs = a.join(b, ["no", "value"]).select("i", "p", "j").distinct()
    assert pairs.filter("i = j").count() == len(set(asked)) and pairs.filter("i <> j").count() < 0.08 * len(asked) * 60


# 6
def test_quality(spark, documents):
    got = rows_by_id(quality.quality_rules(documents))
    assert got[4][0]["n_words"] == 0 and got[4][0]["base_failed"] and not got[4][0]["kept"] and len(got[7]) == 2
    assert quality.quality_rules(documents.limit(0)).count() == 0
    texts = ["a b c d e f g h a b c d e f g h x", "dup\nother\n \ndup\ndup", "#%& |<> plain", " ".join(["same"] * 30), " ".join(f"u{i}" for i in range(25))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert rows[0]["n_repeat_words"] == 16 and rows[1]["n_dup_lines"] == 2 and rows[2]["n_symbols"] == 6 and rows[2]["word_chars"] == 11
    assert rows[3]["n_repeat_words"] == 30 and rows[3]["base_failed"] and rows[4]["kept"]


def test_quality_thresholds_adapt(spark):
    """Symbols that are usual in one source fail in another."""
    text = lambda i, bad: " ".join(f"w{i}x{j}" + ("#" if bad and j % 2 else "") for j in range(40))
    rows = [(i, text(i, i % 2), "en", "marked" if i % 2 else "plain") for i in range(500)] + [(900, text(900, True), "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got.pop(900) is False and all(got.values())


def test_quality_is_not_clipped(spark):
    """Documents beyond any grid are told apart: extreme in a source of extremes, and more extreme."""
    word = lambda n: " ".join(["x" * n] + [f"w{j}" for j in range(24)])
    rows = [(i, word(20_000 + 7 * i), "en", "long") for i in range(300)] + [(900, word(200_000), "en", "long"), (901, word(26_000), "en", "long")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got.pop(900) is False and all(got.values())


def test_sketches_merge(spark, documents):
    measured = quality.measures(documents.unionByName(documents))
    halves = [measured.filter(F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(2)) == k) for k in (0, 1)]
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(quality.merged(*map(quality.sketches, halves))) == shown(quality.sketches(measured))


# 7
def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a href=x>Home</a></nav><!-- <p>no</p> -->
    <div class="ad">Buy this and that for the best of it all</div><article><h1>Head&amp;line</h1><p>The cat <b>sa</b>t on the mat and it was in the house.<p>Yes.<br>No.
    <aside>Other</aside><div class="comments"><p>First of the comments</p></div></article><form>Sign up</form><footer>&copy; x</footer>"""
    assert html.main_text(page) == "Head&line The cat sat on the mat and it was in the house. Yes. No."
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "the of and to " * 50), (1, "u", page)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    assert len(got) == 5 and [r["n_chars"] for r in got if r["page_id"] in (2, 3)] == [0, 0]
    assert next(r for r in got if r["page_id"] is None)["n_chars"] == 699
    assert html.extract(df.limit(0)).count() == 0


def test_html_by_density():
    """Pages without an article element, of scripts with and without the stop words, and boxes whose class only hints."""
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News of the day and more of it for you</a></li></ul>"
    foot = "<div><p>© 2024 Example. All rights reserved.</p></div>"
    page = lambda body: f"<html><body><div>{menu}</div>{body}{foot}"
    english = "The committee met in the morning and it was clear that they had to decide what to do with the money. " * 3
    terse = "Sensor firmware v2 adds calibration tables, faster sampling, lower power draw. " * 4
    russian = "Комитет собрался утром, и стало ясно, что нужно решить, как поступить с деньгами. " * 4
    chinese = "委员会今天上午开会，大家认为必须尽快决定如何使用这笔资金。" * 5
    for text in (english, terse, russian, chinese):
        assert html.main_text(page(f"<div><p>{text}</p></div>")) == text.strip()
        assert html.main_text(page(f"<div class='share-price'><p>{text}</p><p>Short tail.</p></div>")) == text.strip() + " Short tail."
        assert html.main_text(page(f"<div class='share'><p>{text}</p></div><div class='ad box'>{text}</div>")) == ""
        assert html.main_text(f"<article><p>{text}</p><p>The logo is © of its owner.</p></article>") == text.strip() + " The logo is © of its owner."
    assert html.main_text(page(f"<h2>A title</h2><p>{english}</p><p>Yes.</p><div class=comments><p>{english}</p></div>")) == f"A title {english.strip()} Yes."


def test_html_of_broken_markup():
    text = "The cat sat on the mat and it was in the house with all of the others that were there. " * 3
    for page in (f"<p>{text}<div <p", f"<<p>>{text}</b></div></p>", f"<article><p title='>'>{text}<script>x", f"<!-- x --><article><p>{text}<!-- never closed <p>no"):
        assert text.strip() in html.main_text(page), page
    deep = "<div>" * 3000 + f"<p>{text}</p>"
    assert html.main_text(deep) == text.strip()
    long = f"<article>{''.join(f'<p>{i} {text}</p>' for i in range(3000))}"
    assert html.main_text(long).startswith("0 The cat") and len(html.main_text(long)) > 700_000


def test_html_second_pass_is_nearest_neighbours():
    """Against a search of all pairs of blocks."""
    rng = random.Random(6)
    for _ in range(300):
        found = [html.Block(f"b{i}", 0, rng.random() < 0.2, rng.choice((0, 0, 1, 2)), rng.choice(("p", "h2")), rng.choice((0, 0, 0, 1))) for i in range(rng.randrange(1, 12))]
        labels = ["bad" if b.bad else rng.choice(("good", "bad", "undecided", "undecided")) for b in found]
        want = []
        for i, b in enumerate(found):
            decided = [(abs(i - j), labels[j] != "good", j) for j, x in enumerate(found) if (x.section, x.box) == (b.section, b.box) and labels[j] != "undecided" and not (x.bad and x.section)]
            good = labels[i] == "good"
            if labels[i] == "undecided":
                good = not min(decided)[1] if decided else bool(b.section and not b.box)
                if not b.section and decided and all(j > i for _, _, j in decided):
                    good = labels[min(j for _, _, j in decided)] == "good" or good
            want.append(good)
        assert html._second_pass(found, labels) == want


def test_html_against_articles(spark):
    """Of the test pages, whose main text is the article element: almost every word of it, and nothing else."""
    import html as entities

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"] and "<article" in r["html"]]
    same = 0
    for page in pages:
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|$)", page, re.S)[1]
        inner = re.sub(r"<(script|style|aside|form|nav|footer)\b.*?</\1>|<!--.*?-->", " ", inner, flags=re.S)
        want = " ".join(entities.unescape(re.sub(r"</?(?:b|i|em|strong|a|span|u|code|small|sup|sub)\b[^>]*>", "", re.sub(r"<(?!/?(?:b|i|em|strong|a|span|u|code|small|sup|sub)\b)[^>]*>", " ", inner))).split())
        same += " ".join(html.main_text(page).split()) == want
    assert len(pages) > 200 and same >= 0.98 * len(pages)


# 8
def test_token_counts(spark, documents, tmp_path):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kinds = {"words-1": None, "byte-bpe-50k": (path, public_tokenizers.PATTERN)}
    with open(path) as f:
        encoding = rollup._encoding(f.read(), public_tokenizers.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    want = collections.Counter()
    for r in documents.collect():
        for name in kinds:
            want[r["source"], r["lang"], name, "docs"] += 1
            want[r["source"], r["lang"], name, "tokens"] += len(words(r["text"])) if name == "words-1" else len(encoding.encode_ordinary(r["text"] or ""))
    got = {}
    for r in rollup.token_counts(documents, kinds).collect():
        got[r["source"], r["lang"], r["tokenizer"], "docs"] = r["n_docs"]
        got[r["source"], r["lang"], r["tokenizer"], "tokens"] = r["n_tokens"]
    assert got == {k: v for k, v in want.items() if k in got} and len(got) == len(want)
    assert rollup.token_counts(documents.limit(0), kinds).count() == 0


def test_registered_counts_take_the_delta_path(spark, documents, tmp_path, monkeypatch):
    """Batches of all kinds end at the totals of one insert, and their log has signed rows."""
    more = documents.unionByName(documents.filter("doc_id = 1").drop("doc_id").crossJoin(spark.range(100, 140).toDF("doc_id")), allowMissingColumns=True)
    more.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(rollup, "scratch", lambda spark: str(tmp_path / "store"))
    shown = lambda df: sorted(map(str, df.collect()))
    got = shown(queries.op8_token_counts(spark, str(tmp_path)))
    log = [r["sign"] for r in rollup._read(spark, str(tmp_path / "store"), "log", rollup.LOG).collect()]
    folders, known = rollup._committed(spark, str(tmp_path / "store"))
    every = [r["sign"] for name in rollup._folders(spark, str(tmp_path / "store")) for r in spark.read.schema(rollup.LOG).parquet(f"{tmp_path}/store/log/{name}").collect()]
    assert len(folders) == 2 and len(known) == 4 and every.count(-1) > 20 and log.count(-1) == 0
    import public_tokenizers

    kinds = {"words-1": None, "byte-bpe-50k": (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    monkeypatch.setattr(rollup, "scratch", lambda spark: str(tmp_path / "plain"))
    assert got == shown(rollup.token_counts(more, kinds)) and len(got) > 4
    monkeypatch.setattr(rollup, "scratch", lambda spark: str(tmp_path / "none"))
    assert rollup.token_counts_by_batches(documents.limit(0), kinds).count() == 0


def test_rollup_batches(spark, tmp_path):
    store, words_only = str(tmp_path / "store"), {"words-1": None}
    docs = lambda rows: rollup.counts(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"), words_only)
    total = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals(spark, store).collect()}
    assert rollup.apply_batch(spark, store, "1", docs([(1, "a b", "s", "en"), (2, "c", "s", None), (3, "d e f", "t", "en")]))
    assert total() == {("s", "en"): (1, 2), ("s", None): (1, 1), ("t", "en"): (1, 3)}
    assert not rollup.apply_batch(spark, store, "1", docs([(1, "changed text here", "s", "en")]))
    assert rollup.apply_batch(spark, store, "2", docs([(1, "a b c d", "s", "en"), (4, "x", "t", "en")]), spark.createDataFrame([(2,), (77,)], "doc_id bigint"))
    assert total() == {("s", "en"): (1, 4), ("t", "en"): (2, 4)}
    assert rollup.apply_batch(spark, store, "3") and total() == {("s", "en"): (1, 4), ("t", "en"): (2, 4)}
    assert rollup.apply_batch(spark, store, "4", docs([(3, "d", "s", "en")])) and total() == {("s", "en"): (2, 5), ("t", "en"): (1, 1)}


def test_rollup_of_a_tokenizer_added_later(spark, tmp_path):
    """A count replaces that of the same document and tokenizer only; deletes take all, null ids included; compaction changes no total."""
    store = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")
    total = lambda: {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals(spark, store).collect()}
    rollup.apply_batch(spark, store, "1", rows((1, "s", "en", "v1", 10), (2, "s", "en", "v1", 20), (None, "s", "en", "v1", 5)))
    rollup.apply_batch(spark, store, "2", rows((1, "s", "en", "v2", 8), (2, "s", "en", "v2", 18)))
    assert total() == {("s", "v1"): (3, 35), ("s", "v2"): (2, 26)}
    rollup.apply_batch(spark, store, "3", rows((2, "t", "en", "v2", 19)))
    assert total() == {("s", "v1"): (3, 35), ("s", "v2"): (1, 8), ("t", "v2"): (1, 19)}
    rollup.compact(spark, store)
    assert total() == {("s", "v1"): (3, 35), ("s", "v2"): (1, 8), ("t", "v2"): (1, 19)} and len(rollup._committed(spark, store)[0]) == 1
    assert not rollup.apply_batch(spark, store, "2", rows((1, "s", "en", "v2", 99)))
    ids = spark.createDataFrame([(None,), (1,), (1,)], "doc_id bigint")
    assert rollup.apply_batch(spark, store, "4", rows((1, "s", "en", "v1", 11)), ids)
    assert total() == {("s", "v1"): (2, 31), ("t", "v2"): (1, 19)}
    rollup.compact(spark, store)
    rollup.compact(spark, store)
    assert total() == {("s", "v1"): (2, 31), ("t", "v2"): (1, 19)}


# 9
def test_bpe(spark, documents):
    import numpy as np
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    library = Tokenizer.from_file(path)
    odd = ["", " ", "Hello<|endoftext|>WORLD it's don't", "ΑΣ ΟΔΟΣ İstanbul ﬁ Å 日本語", "a\x1cb\x85c\xa0d", "x\x00y", "🙂 é", "aaaaaaaaaaaaaa", "12½²", "ǅ ß ſ K"]
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = rows_by_id(df)
    for i, rs in rows_by_id(bpe.digests(df, path)).items():
        ids = library.encode(texts[i][0]["text"] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want for r in rs)
    whole = bpe.encode(df, path)
    back = rows_by_id(bpe.decode(whole, path))
    assert all(back[i][0]["text"] == rs[0]["decoded"] for i, rs in rows_by_id(whole).items())
    assert bpe.digests(documents.limit(0), path).count() == 0


def test_batches_of_texts_are_small_for_a_while(spark):
    names = list(common.TEXT_BATCHES)
    before = [spark.conf.get(n) for n in names]
    with common.text_batches(spark):
        assert [spark.conf.get(n) for n in names] == [str(x) for x in common.TEXT_BATCHES.values()]
    spark.conf.set(names[1], "7")
    with pytest.raises(ZeroDivisionError), common.text_batches(spark):
        assert spark.conf.get(names[1]) == "7"
        raise ZeroDivisionError
    assert [spark.conf.get(n) for n in names] == [before[0], "7"]
    spark.conf.set(names[1], before[1])


# 10
SECRET = 'x password: "hunter22" token=abc secret:token :abcdefg AKIA' + "Z" * 16 + " AKIASHORT 0123456789abcdef0123456789 API_KEY = k/+=.- ghp_" + "a" * 36


def test_secrets(spark, documents):
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(50, SECRET), (51, "é" + SECRET), (52, SECRET)], "doc_id bigint, text string")).withColumn("_blob", F.lit(1))
    got = rows_by_id(secrets.secret_scans(df))
    for i, shift in ((50, 0), (51, 1), (52, 0)):
        text = ("é" if shift else "") + SECRET
        spans = []
        for k, (kind, pattern, least) in enumerate([("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)]):
            spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
        want = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(spans))
        assert got[i][0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert "github:" in got[i][0]["spans"] and got[i][0]["n_access"] == 1
    assert got[4][0]["spans"] == "" and len(got[7]) == 2 and got[4][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_scans(documents.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, text string")
    first = secrets.scan_ledger(rows(("a", SECRET), ("b", "nothing"), ("c", SECRET)), ledger, "1", ["base-1"])
    assert sorted((r["path"], len(r["spans"])) for r in first.collect())[1] == ("b", 0)
    assert secrets.read_ledger(spark, ledger).count() == 2
    secrets.scan_ledger(rows(("d", SECRET), ("e", "more")), ledger, "2").collect()
    counted = {(r["version"]): r["count"] for r in secrets.read_ledger(spark, ledger).groupBy("version").count().collect()}
    assert counted == {"base-1": 3, "vendor-1": 2}
    secrets.scan_ledger(rows(("d", SECRET), ("e", "more")), ledger, "2").collect()
    assert secrets.read_ledger(spark, ledger).count() == 5


def test_a_used_batch_id_hides_nothing(spark, tmp_path):
    """Rows of unseen blobs are scanned, though their batch id was committed."""
    ledger = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, text string")
    assert secrets.commit_batch(rows(("a", "nothing")), ledger, "1") and not secrets.commit_batch(rows(("a", "nothing")), ledger, "1")
    got = secrets.scan_ledger(rows(("b", SECRET), ("a", "nothing")), ledger, "1").collect()
    assert {r["path"]: bool(r["spans"]) for r in got} == {"a": False, "b": True}
    assert not secrets.commit_batch(rows(("b", SECRET)), ledger, "1") and secrets.read_ledger(spark, ledger).count() == 4


def test_secrets_by_batches(spark, documents):
    """The registered query's ledger grows by batches and ends at the spans of one scan; a heavy blob is joined apart."""
    more = documents.select("doc_id", "text").union(spark.range(60, 100).selectExpr("id", f"'{SECRET.replace(chr(39), '')}'"))
    shown = lambda df: sorted(map(str, df.collect()))
    want = shown(secrets.secret_scans(more))
    assert shown(secrets.secret_scans_by_batches(more)) == want
    assert secrets.secret_scans_by_batches(documents.limit(0)).count() == 0


@pytest.mark.parametrize("heavy", [2, 10_000])
def test_findings_of_heavy_blobs_and_clashing_names(spark, tmp_path, heavy, monkeypatch):
    monkeypatch.setattr(secrets, "HEAVY", heavy)
    rows = [(i, SECRET if i % 3 else None if i % 2 else "") for i in range(30)] + [(99, "token=abcdefgh")]
    df = spark.createDataFrame(rows, "path long, text string").selectExpr("*", "1 _blob", "2 _heavy", "3 _held", "4 _own", "5 _of", "6 spans", "map(1, 2) m")
    got = secrets.scan_ledger(df, str(tmp_path / "l"), "1", out="found")
    assert got.columns == [*df.columns, "found"]
    assert sorted((r["path"], bool(r["found"]), r["_of"], r["spans"]) for r in got.collect()) == sorted((i, bool(t), 5, 6) for i, t in rows)


def test_a_text_full_of_secrets(spark, tmp_path):
    """Spans and marks of thousands of findings in one text, overlapping ones included."""
    one = "token=abcdefgh é password=0123456789abcdef0123456789 "
    text = one * 2500
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = secrets.scan_ledger(df, str(tmp_path / "l"), "1").cache()
    spans = [(s["start"], s["end"]) for s in found.first()["spans"]]
    want = sorted((m.start(), m.end()) for p in (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"[0-9a-f]{24,}") for m in re.finditer(p, text))
    assert spans == want and len(want) == 7500
    assert found.select(secrets.redact(F.col("text"), F.col("spans")).alias("t")).first()["t"] == "[secret] é [secret] " * 2500
    found.unpersist()


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh end"), (2, "clean"), (3, None)], "doc_id bigint, text string")
    import tempfile

    found = secrets.scan_ledger(df, tempfile.mkdtemp() + "/l", "1")
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [secret] end", 2: "clean", 3: None}
