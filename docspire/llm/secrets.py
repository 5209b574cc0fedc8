"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The
ledger holds a row for each (blob, rule version) that was ever scanned, with
the spans found. A run scans the pairs that the ledger lacks, commits them as
one batch, and joins the findings back to every row that holds the blob, so
copies and old versions are scanned once. A batch counts when its folder has
Spark's _SUCCESS mark: a repeated batch of the same rows is a no-op, rows that it
lacked are scanned, and a batch that a lost driver left unfinished is written
anew. One writer commits at a time; two at once would scan a pair twice.

Defined results: a null text is an empty one; repeated rows each get the spans
of their blob; an empty table commits an empty batch; a column of the input with
the name asked for, `spans` unless another is, is replaced, and other columns stay
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, cut, fit_broadcast, fresh_name, let, running, scratch, text_batches

_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: Rule version -> rules of (kind, pattern, literals one of which the lower-cased text must hold, pattern to cut from a match, least length of the rest).
RULES: dict[str, list[tuple[str, str, list[str], str, int]]] = {
    "base-1": [
        ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", ["passw", "secret", "token", "key"], "^" + _ASSIGN, 6),
        ("access", "AKIA[A-Z0-9]+", ["akia"], "", 20),
        # A run of [0-9a-f]+ is maximal, so runs of 24 and more are the same as {24,}.
        ("hex", "[0-9a-f]{24,}", [], "", 24),
    ],
    "vendor-1": [
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ["-----begin"], "", 0),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "", 0),
        ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", ["eyj"], "", 0),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", ["xox"], "", 0),
        ("google", "AIza[A-Za-z0-9_-]{35}", ["aiza"], "", 0),
        ("bearer", "(?i:bearer)\\x20+[A-Za-z0-9._~+/-]{20,}", ["bearer"], "", 0),
        ("login", "://[^\\x20\\x09-\\x0D/:@]+:[^\\x20\\x09-\\x0D/@]+@", ["://"], "", 0),
    ],
}
KINDS = [rule[0] for rules in RULES.values() for rule in rules]
BASE = {"assign", "access", "hex"}
SPAN = "struct<start:int,kind:int,end:int>"
#: A blob of more rows than this is joined by broadcast if such blobs are at most `BROADCAST_ROWS`: one may be held by a third of all rows.
HEAVY, BROADCAST_ROWS = 10_000, 100_000


def _spans(text: Column, rule: tuple[str, str, list[str], str, int]) -> Column:
    """The spans of a rule, leftmost and not overlapping, in code points."""
    kind, pattern, needles, cut_off, least = rule
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        def of_gaps(gaps: Column) -> Column:
            steps = F.transform(found, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))

            def of_ends(ends: Column) -> Column:
                def span(hit: Column, i: Column) -> Column:
                    end = F.get(ends, i)
                    good = F.length(F.regexp_replace(hit, cut_off, "") if cut_off else hit) >= least
                    return F.when(good, F.struct((end - F.length(hit)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")).cast(SPAN))

                return F.filter(F.transform(found, span), lambda x: x.isNotNull())

            return let(running(steps, lambda a, x: a + x), of_ends)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), of_gaps))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if not needles:
        return spans
    held = F.lit(False)
    for needle in needles:
        held |= F.contains(F.lower(text), F.lit(needle))
    return F.when(held, spans).otherwise(none)


def scan(text: Column, version: str) -> Column:
    """All spans of one rule version."""
    return F.concat(*[_spans(text, rule) for rule in RULES[version]])


def _batches(spark: SparkSession, ledger: str) -> list[str]:
    """The committed batch folders of a ledger."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(x.toString() for x in done if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, version, spans) of every committed batch."""
    schema = f"blob binary, version string, spans array<{SPAN}>"
    paths = _batches(spark, ledger)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def commit_batch(rows: DataFrame, ledger: str, batch: str, versions: list[str] | None = None) -> bool:
    """Scan the (blob, version) pairs of `rows` that the ledger lacks and commit them; False if the batch was committed and lacks none.

    A repeated batch with the same rows lacks nothing. One that brings other
    blobs under a used id is scanned all the same, as a further folder of that batch.
    """
    spark, versions = rows.sparkSession, list(RULES) if versions is None else versions
    done = _batches(spark, ledger)
    names = {p.rstrip("/").rpartition("/")[2] for p in done}
    name = f"batch-{batch}"
    seen = read_ledger(spark, ledger).filter(F.col("version").isin(versions)).groupBy("blob").agg(F.collect_set("version").alias("seen")) if done else None
    if name in names:
        # Digests alone tell whether a pair is new.
        held = rows.select(_blob(F.col("text")).alias("blob")).distinct().join(seen.filter(F.size("seen") == len(set(versions))), "blob", "left_anti")
        if held.isEmpty():
            return False
        name = next(x for x in (f"{name}+{k}" for k in range(2, len(names) + 3)) if x not in names)
    blobs = rows.select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    blobs = blobs.join(seen, "blob", "left") if done else blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    known = F.coalesce("seen", F.array().cast("array<string>"))
    made = F.array(*[F.when(~F.array_contains(known, v), F.struct(F.lit(v).alias("version"), scan(F.col("text"), v).alias("spans"))) for v in versions])
    fresh = blobs.select("blob", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
    with text_batches(spark):
        fresh.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/{name}")
    return True


def findings(rows: DataFrame, ledger: str, versions: list[str] | None = None, out: str = "spans") -> DataFrame:
    """`rows` with the spans that the ledger holds of their texts in column `out`."""
    spark, versions = rows.sparkSession, list(RULES) if versions is None else versions
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    blob, heavy, held = (fresh_name(rows, c) for c in ("_blob", "_heavy", "_held"))
    found = read_ledger(spark, ledger).filter(F.col("version").isin(versions) & (F.size("spans") > 0))
    # A row for each version: a few to a blob.
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias(held)).withColumnRenamed("blob", heavy)
    none = F.array().cast(f"array<{SPAN}>")
    # Blobs of many rows, the empty one among them, are few: these rows stay where they are.
    many = rows.select(_blob(F.col("text")).alias(blob)).groupBy(blob).count().filter(F.col("count") > HEAVY)
    many = cut(many.join(found, F.col(blob) == F.col(heavy), "left").select(F.col(blob).alias(heavy), F.coalesce(held, none).alias(held)))
    own = fresh_name(rows, "_own")
    side = many.select(F.col(heavy).alias("_of"), F.col(held).alias(own))
    of = fresh_name(rows, "_of")
    side = side.withColumnRenamed("_of", of)
    marked = rows.select(*kept, _blob(F.col("text")).alias(blob)).join(fit_broadcast(side, BROADCAST_ROWS, F.size(own)), F.col(blob) == F.col(of), "left")
    # Their keys find nothing in the join that shuffles, and spread by their other columns, the same again if a lost task is repeated.
    hashable = [c for c, kind in rows.dtypes if c in kept and c != "text" and "map<" not in kind and "variant" not in kind]
    spread = F.unhex(F.sha2(F.xxhash64(F.lit(7), *hashable).cast("string"), 256))
    keys = marked.withColumn(blob, F.when(F.col(of).isNull(), F.col(blob)).otherwise(spread))
    # One plan at every size: findings grow with the rows and are never broadcast.
    joined = keys.join(found.hint("merge"), F.col(blob) == F.col(heavy), "left")
    return joined.select(*kept, F.coalesce(own, held, none).alias(out))


def scan_ledger(rows: DataFrame, ledger: str, batch: str, versions: list[str] | None = None, out: str = "spans") -> DataFrame:
    """`rows` with their spans from the ledger, which first gets what it lacks."""
    commit_batch(rows, ledger, batch, versions)
    return findings(rows, ledger, versions, out)


def redact(text: Column, spans: Column) -> Column:
    """`text` with every run of overlapping spans, which are in order of their starts, replaced by one mark."""

    def of_tops(tops: Column) -> Column:
        """`tops`: the greatest end of the spans up to each."""
        items = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(tops, i - 1), F.lit(0)).alias("prev")))

        def piece(block: Column) -> Column:
            # Cut out of the text once for a block, so that many spans don't each walk through it.
            at = F.get(block, F.lit(0))["prev"]
            part = F.substring(text, at + 1, F.greatest(F.lit(0), F.element_at(block, -1)["start"] - at))
            shown = lambda held: F.transform(
                block,
                lambda x: F.when(x["start"] >= x["prev"], F.concat(F.substring(held, x["prev"] - at + 1, x["start"] - x["prev"]), F.lit("[secret]"))).otherwise(F.lit("")),
            )
            return F.array_join(let(part, shown), "")

        pieces = let(items, lambda xs: F.transform(blocks_of(xs), piece))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(tops, -1) + 1, F.lit(2**31 - 1)))

    return F.when(F.size(spans) == 0, text).otherwise(let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), of_tops))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of rows with `doc_id` and `spans`."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, shown), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(len(BASE))],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def secret_scans(docs: DataFrame, ledger: str | None = None, batch: str = "first") -> DataFrame:
    """Spans of every document, by way of a ledger of its own unless one is named."""
    return digest(scan_ledger(docs.select("doc_id", "text"), ledger or scratch(docs.sparkSession), batch))


def secret_scans_by_batches(docs: DataFrame) -> DataFrame:
    """The same spans, from a ledger that grew by batches.

    The first has half of the rows; the second a quarter, under the base rules
    alone; the third that quarter again and the rest under all rules, so of the
    quarter only the other rules are run; then the first comes once more.
    """
    rows, ledger = docs.select("doc_id", "text"), scratch(docs.sparkSession)
    share = lambda *n: rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)).isin(*n))
    commit_batch(share(0, 1), ledger, "1-half")
    commit_batch(share(2), ledger, "2-base-rules", ["base-1"])
    commit_batch(share(2, 3), ledger, "3-rest")
    if commit_batch(share(0, 1), ledger, "1-half"):
        raise RuntimeError("a repeated batch was scanned again")
    return digest(findings(rows, ledger))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for no, (kind, pattern, _, cut_off, least) in enumerate(rule for rules in RULES.values() for rule in rules):
        rest = f"regexp_replace(m, {quoted(cut_off)}, '')" if cut_off else "m"
        parts.append(
            f"SELECT doc_id, {no} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, ms[i] AS m, "
            f"coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s "
            f"FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS ms, "
            f"string_split_regex(t, {quoted(pattern)}) AS ps FROM d))) WHERE length({rest}) >= {least}"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""  # noqa: S608


SECRETS_SQL = _sql()
