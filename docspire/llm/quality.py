"""Quality rules with thresholds learnt from each language and source.

A document's measures are per-mille ratios of counts. Each (language, source)
has a quantile sketch of every measure: counts by cell, so two sketches merge by
adding counts. Cells are `CELL` wide up to `LINEAR` of them and from there grow
with the value, `LINEAR / 2` to each power of two, so no value is clipped, a sketch
has at most ``LINEAR * 28`` cells whatever the number of documents, and a quantile
is off by less than one cell or 1 in 512. Sketches are written as a table, and
those of a language and of all documents are merged from it. Groups of fewer than
`MIN_GROUP` documents use the sketch of their language, and languages of fewer the
sketch of all documents. A document fails a measure beyond
``q75 + WIDTH * (q75 - q25) + slack``. The share of repeated words has a fixed
limit, the base rule's, and no learnt one.

Defined results: a null or empty text has zero counts and fails the base rule;
a null language or source is a group of its own; repeated rows are judged row
by row; an empty table gives an empty table; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, let, run_hashes, words

MIN_WORDS, MAX_REPEAT_PCT = 20, 30
WINDOW = 8
#: Per-mille width of a cell, and the number of cells of that width; a power of two.
CELL, LINEAR = 20, 1024
MIN_GROUP = 200
WIDTH = 6
#: Per-mille slack of each measure, which holds where all documents are alike.
SLACK = {"symbols": 200, "dup_lines": 400, "word_len": 600}
SALTS = 16
SYMBOLS = "#*$%&|<>"


def _repeat_words(ws: Column) -> Column:
    """Words in windows that occur twice or more in `ws`, the first one included.

    Each window has a 64-bit hash of its words' hashes; where all differ, as in
    most texts, nothing repeats. Else windows sort by hash, and neighbours of equal
    hash count as equal only if their words are, so a collision can't make a repeat.
    """

    def cover(hs: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            x, y = F.get(hs, a), F.get(hs, b)
            return F.coalesce((x["h"] == y["h"]) & (F.slice(ws, x["i"] + 1, WINDOW) == F.slice(ws, y["i"] + 1, WINDOW)), F.lit(False))

        hit = F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        at = F.array_sort(F.transform(hit, lambda k: F.get(hs, k)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end"))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(at, start, step, lambda a: a["n"]))

    def counted(hs: Column) -> Column:
        placed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(F.sort_array(placed), cover))

    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(run_hashes(ws, WINDOW), counted))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda c: F.length(F.translate(c, SPACES, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) > 0)
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    listed = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    made = docs.select(
        "doc_id", "lang", "source",
        bare(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        counted.alias("_w"), listed.alias("_l"),
    )
    return made.select(
        "doc_id", "lang", "source",
        F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.d").cast("long").alias("n_dup_lines"), F.col("_w.r").cast("long").alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"),
    )


def _cells() -> dict[str, Column]:
    """The cell of each measure, named by its lower edge in units of `CELL`."""
    ratio = lambda a, b: f"(1000 * {a}) div greatest(1, {b}) div {CELL}"
    drop = lambda v: f"greatest(0, length(bin({v})) - {LINEAR.bit_length() - 1})"  # noqa: E731  low bits that a cell leaves out
    cell = lambda a, b: F.expr(f"shiftleft(shiftright({ratio(a, b)}, {drop(ratio(a, b))}), {drop(ratio(a, b))})")
    return {"symbols": cell("n_symbols", "n_words"), "dup_lines": cell("n_dup_lines", "n_lines"), "word_len": cell("word_chars", "n_words")}


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): the sketch of each group. Sketches merge by `merged`."""
    rows = measured.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.alias("cell")) for k, c in _cells().items()])).alias("m"),
    ).select("lang", "source", "m.*")
    return rows.groupBy("lang", "source", "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """The sketches of all rows of several parts."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "source", "measure", "cell").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """The limits of each level: (level, lang, source) and one column for each measure, in units of `CELL`.

    Level 0 is a language and source, 1 a language, 2 all. Levels of too few
    documents are absent, but for level 2.
    """
    none = F.lit(None).cast("string")
    levels = sketch.select(F.lit(0).alias("level"), "lang", "source", "measure", "cell", "n")
    for level, keep in ((1, "lang"), (2, None)):
        up = sketch.groupBy(*([keep] if keep else []), "measure", "cell").agg(F.sum("n").alias("n"))
        levels = levels.unionByName(
            up.select(F.lit(level).alias("level"), (F.col("lang") if keep else none).alias("lang"), none.alias("source"), "measure", "cell", "n")
        )
    # The number of cells of a sketch is bounded, and so is each list.
    packed = levels.groupBy("level", "lang", "source", "measure").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells")
    )

    def quantile(pct: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("at"))

        def step(a: Column, c: Column) -> Column:
            n = a["n"] + c["n"]
            return F.struct(n.alias("n"), F.when((a["at"] < 0) & (100 * n >= pct * F.col("total")), c["cell"]).otherwise(a["at"]).alias("at"))

        return F.aggregate("cells", start, step, lambda a: a["at"])

    limit = F.col("q75") + WIDTH * (F.col("q75") - F.col("q25")) + F.col("slack")
    slack = F.create_map(*[x for k, v in SLACK.items() for x in (F.lit(k), F.lit(v // CELL).cast("long"))])
    return (
        packed.filter((F.col("total") >= MIN_GROUP) | (F.col("level") == 2))
        .select("level", "lang", "source", "measure", quantile(25).alias("q25"), quantile(75).alias("q75"), slack[F.col("measure")].alias("slack"))
        .groupBy("level", "lang", "source")
        .agg(*[F.max(F.when(F.col("measure") == k, limit)).alias(k) for k in SLACK])
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every document of (doc_id, text, lang, source)."""
    measured = cut(measures(docs))  # read twice: for the sketches and for the verdict
    limits = cut(thresholds(cut(sketches(measured))))  # a row for each group
    cells = _cells()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    out = measured.withColumns({f"_{k}": c for k, c in cells.items()} | {"_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    for level in (0, 1, 2):
        keys = (["lang", "source"], ["lang"], [])[level]
        side = limits.filter(F.col("level") == level).select(
            *[F.col(k).alias(f"{k}_{level}") for k in keys],
            F.struct(*cells).alias(f"limit_{level}"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias(f"salt_{level}"),
        )
        on = F.col("_salt") == F.col(f"salt_{level}")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"{k}_{level}"))
        out = out.join(side, on, "left").drop(f"salt_{level}", *[f"{k}_{level}" for k in keys])
    limit = F.coalesce("limit_0", "limit_1", "limit_2")
    passed = F.lit(True)
    for k in cells:
        passed &= F.coalesce(F.col(f"_{k}") <= limit[k], F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"),
    )


#: The same result in DuckDB, written apart from the above.
QUALITY_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - {WINDOW - 1}))) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM hit) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
r AS (
  SELECT *, (1000 * n_symbols) // greatest(1, n_words) // {CELL} AS v_symbols,
         (1000 * n_dup_lines) // greatest(1, n_lines) // {CELL} AS v_dup_lines,
         (1000 * word_chars) // greatest(1, n_words) // {CELL} AS v_word_len
  FROM m),
c AS (SELECT *, {", ".join(f"v_{k} // (1::BIGINT << greatest(0, length(bin(v_{k})) - {LINEAR.bit_length() - 1})) * (1::BIGINT << greatest(0, length(bin(v_{k})) - {LINEAR.bit_length() - 1})) AS {k}" for k in SLACK)} FROM r),
lim AS (
  SELECT level, lang, source, {", ".join(f"quantile_disc({k}, 0.75) + {WIDTH} * (quantile_disc({k}, 0.75) - quantile_disc({k}, 0.25)) + {v // CELL} AS l_{k}" for k, v in SLACK.items())}
  FROM (SELECT 0 AS level, lang, source, symbols, dup_lines, word_len FROM c
        UNION ALL SELECT 1, lang, NULL, symbols, dup_lines, word_len FROM c
        UNION ALL SELECT 2, NULL, NULL, symbols, dup_lines, word_len FROM c)
  GROUP BY ALL HAVING count(*) >= {MIN_GROUP} OR level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
        AND {" AND ".join(f"{k} <= coalesce(a.l_{k}, b.l_{k}, d.l_{k})" for k in SLACK)}) AS kept
FROM c
LEFT JOIN lim a ON a.level = 0 AND c.lang IS NOT DISTINCT FROM a.lang AND c.source IS NOT DISTINCT FROM a.source
LEFT JOIN lim b ON b.level = 1 AND c.lang IS NOT DISTINCT FROM b.lang
LEFT JOIN lim d ON d.level = 2
"""  # noqa: S608
