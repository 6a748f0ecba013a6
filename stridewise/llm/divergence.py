"""Audit of how sources of a language diverge, by wide term vectors.

Each kept term of a language becomes one row with an array of its counts, one
entry for each source of the language. JVM higher-order functions turn the
counts into smoothed shares and emit what each pair of sources adds to their
divergence; sums are made in every task before the shuffle. All numbers are
whole ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridewise.llm import textbytes as tb
from stridewise.llm.common import materialize, release

#: Documents of a language that a kept term occurs in at least, and ranks of the list of terms.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Shares are counted in parts of SCALE ** SCALE_STEPS.
SCALE, SCALE_STEPS = 1000, 3
#: Groups (sources of languages) whose names and sums are sent to all tasks at most; more are joined by a shuffle.
SENT_GROUPS = 1 << 16

#: Bytes that separate terms once A-Z are lower case, as closed ranges.
_IS_TERM = tb.byte_class((0x00, 0x60), (0x7B, 0x7F))

RESULT = ("lang", "source", "part", "item", "value", "rank")


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte runs as a text array."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def _term_rows(batches):
    """(lang, source, text) -> lang, source, term, documents with it and occurrences, folded in each slice of a batch."""
    for batch in batches:
        groups = pa.StructArray.from_arrays([c.dictionary_encode().indices for c in batch.columns[:2]], names=["lang", "source"])
        codes = groups.field(0).to_numpy().astype(np.int64) * batch.num_rows + groups.field(1).to_numpy()
        for first, raw, offsets in tb.text_slices(batch.column(2)):
            data = tb.LOWER[raw]
            starts, ends, rows = tb.word_bounds(data, offsets, _IS_TERM)
            if not len(starts):
                continue
            own = codes[first + rows]
            # of other bytes in the second hash, so that terms which agree in one by chance differ in the other
            key = tb.mix(tb.word_hashes(data, starts, ends) + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            other = tb.word_hashes(data ^ np.uint8(0xA5), starts, ends)
            order = np.argsort(key, kind="stable")  # terms stay in the order of their rows
            fresh = np.ones(len(order), bool)
            np.not_equal(key[order][1:], key[order][:-1], out=fresh[1:])
            apart = (other[order][1:] != other[order][:-1]) | (own[order][1:] != own[order][:-1])
            if (apart & ~fresh[1:]).any():
                order = np.lexsort((rows, own, other, key))
                fresh[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1]) | (own[order][1:] != own[order][:-1])
            own_row = fresh.copy()
            own_row[1:] |= rows[order][1:] != rows[order][:-1]
            runs = np.flatnonzero(fresh)
            lead = order[runs]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(first + rows[lead])) for c in batch.columns[:2]), _gathered(data, starts[lead], ends[lead]),
                    pa.array(np.add.reduceat(own_row.astype(np.int64), runs)), pa.array(np.diff(np.append(runs, len(order)))),
                ],
                names=["lang", "source", "term", "docs", "n"],
            )


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in steps that stay whole and small."""
    over = total + 2 * terms

    def digit(held: Column, _: int) -> Column:
        left = held["left"] * SCALE
        return F.struct((held["share"] * SCALE + F.call_function("div", left, over)).alias("share"), (left % over).alias("left"))

    first = F.struct(F.lit(0).cast("long").alias("share"), (count + 2).alias("left"))
    return reduce(digit, range(SCALE_STEPS), first)["share"] + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _dense(entries: Column, sources: Column) -> Column:
    """Counts by source index, from (index, n) in the order of indices."""
    zero = F.lit(0).cast("long")

    def one(entry: Column, k: Column) -> Column:
        before = F.when(k == 0, -1).otherwise(F.get(entries, k - 1)["index"])
        return F.concat(F.array_repeat(zero, entry["index"] - before - 1), F.array(entry["n"]))

    rest = sources - 1 - F.element_at(entries, -1)["index"]
    return F.concat(F.flatten(F.transform(entries, one)), F.array_repeat(zero, rest))


def wide_vectors(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """lang, term, counts (by source index) of the kept terms; groups: lang, source, index, sources."""
    terms = docs.select("lang", "source", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counted = terms.mapInArrow(_term_rows, "lang string, source string, term string, docs long, n long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    placed = counted.join(groups, ["lang", "source"])
    whole = placed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("index", "n"))).alias("entries"), F.sum("docs").alias("docs"), F.first("sources").alias("sources"))
    return whole.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", _dense(F.col("entries"), F.col("sources")).alias("counts"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    A term is a run of A-Z, a-z and characters beyond ASCII, A-Z lower-cased;
    a language keeps those in LEAST_DOCS of its rows or more. p is a source's
    smoothed share of a term in thousand-millionths, q the language's. Part
    ``pair``: item is each other source of the language, value the sum over
    all kept terms of (p - p')^2 / (p + p'), rounded down term by term. Part
    ``term``: the TOP_TERMS terms that occur in the source and have p > q, by
    (p - q)^2 / (p + q). Ranks count from 1 by falling value, then by item.

    Null text, lang and source are empty text; repeated rows count as often as
    they are there, whatever their ids; a source without terms has pairs alone,
    of value 0 if its language keeps no term; an empty table gives no row.
    Other columns are ignored. A row holds one number for each source of its
    language, so sources should be many thousands at most.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    named = rows.groupBy("lang", "source").agg(F.lit(True).alias("there"))
    per_lang = Window.partitionBy("lang")
    index = F.row_number().over(per_lang.orderBy("source")) - 1
    groups = materialize(named.select("lang", "source", index.alias("index"), F.count("*").over(per_lang).cast("int").alias("sources")), "divergence-groups")
    sent = F.broadcast if groups.count() <= SENT_GROUPS else (lambda df: df)
    vectors = materialize(wide_vectors(rows, sent(groups)), "divergence-vectors")

    # of each language: its sources by index, their sums over kept terms, and the number of those
    zero = F.lit(0).cast("long")
    sums = vectors.select("lang", F.posexplode("counts").alias("index", "n")).groupBy("lang", "index").agg(F.sum("n").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("terms"))
    entry = F.struct("index", "source", F.coalesce("total", zero).alias("total"))
    listed = groups.join(sums, ["lang", "index"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    totals = listed.join(kept, "lang", "left").select("lang", F.transform("entries", lambda e: e["source"]).alias("sources"), F.transform("entries", lambda e: e["total"]).alias("totals"), F.coalesce("terms", zero).alias("terms"))
    totals = materialize(totals, "divergence-totals")

    smooth = F.transform(F.arrays_zip("counts", "totals"), lambda e: _share(e["counts"], e["totals"], F.col("terms")))
    add = lambda values: F.aggregate(values, zero, lambda a, b: a + b)
    shares = vectors.join(sent(totals.drop("sources")), "lang").select("lang", "term", "counts", smooth.alias("p"), _share(add("counts"), add("totals"), F.col("terms")).alias("q"))

    # each term adds to each pair of sources, the smaller index first
    first = shares.select("lang", "p", F.posexplode("p").alias("i", "own")).where(F.col("i") + 1 < F.size("p"))
    rest = F.slice("p", F.col("i") + 2, F.size("p"))
    added = first.select("lang", "i", F.posexplode(F.transform(rest, lambda other: _gap(F.col("own"), other))).alias("gap", "value"))
    half = added.groupBy("lang", "i", (F.col("i") + 1 + F.col("gap")).alias("j")).agg(F.sum("value").alias("value"))
    half = materialize(half, "divergence-pairs")
    each = half.unionByName(half.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    mates = totals.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i != j")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = mates.join(each, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    both = shares.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("index", "own"))
    above = both.where("own.counts > 0 and own.p > q").select("lang", "index", F.col("term").alias("item"), _gap(F.col("own.p"), F.col("q")).alias("value"))
    # the limit on ranks lets tasks drop rows before the shuffle
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "index").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= TOP_TERMS)
    terms = ranked.join(sent(groups.select("lang", "index", "source")), ["lang", "index"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    found = materialize(pairs.unionByName(terms).select(*RESULT), "divergence")
    release(groups, vectors, totals, half)
    return found


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 2) AS HUGEINT) // (coalesce(s.total, 0) + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + CAST(1000000000 * (sum(n) + 2) AS HUGEINT) // (any_value(l.total) + 2 * any_value(v.v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY 1) AS l USING (lang) GROUP BY 1, 2
), added AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(added.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN added ON added.lang = a.lang AND added.source = a.source AND added.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
