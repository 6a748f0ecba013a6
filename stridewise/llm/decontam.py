"""Benchmark decontamination by winnowing.

Training and test texts are cut into words; of every ``SPAN`` consecutive
words the smallest k-gram hash is kept as a fingerprint. A span of SPAN words
that both sides share has the same smallest hash on both sides, so each such
span is found: the fingerprints of both sides are joined, hits are extended to
the whole windows around them, and windows are joined with the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.llm import textbytes as tb
from stridewise.llm.common import materialize, release

#: Words of a benchmark window.
SPAN = 10
#: Words of a hashed gram; SPAN - GRAM + 1 grams lie in a window.
GRAM = 5
#: Benchmark fingerprints that are sent to all tasks at most, eight bytes each; more are joined by a shuffle.
SENT_PRINTS = 1 << 20

#: Bytes that separate words once A-Z are lower case, as closed ranges; and the pattern of a word before that.
_IS_WORD = tb.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, second hashes of the words, their rows) of each slice of a text column."""
    for first, raw, offsets in tb.text_slices(column):
        data = tb.LOWER[raw]
        starts, ends, rows = tb.word_bounds(data, offsets, _IS_WORD)
        if len(starts):
            # of other bytes, so that words which agree in one hash by chance differ in the other
            yield first, tb.word_hashes(data, starts, ends), tb.word_hashes(data ^ np.uint8(0xA5), starts, ends), rows


def _winnowed(words: np.ndarray) -> np.ndarray:
    """Smallest hash of the grams in each run of SPAN words."""
    grams = tb.gram_hashes(words, GRAM)
    count = max(0, len(words) - SPAN + 1)
    least = grams[:count].copy()
    for j in range(1, SPAN - GRAM + 1):
        np.minimum(least, grams[j : j + count], out=least)
    return least


def _prints(words: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of ``length`` words; that of a short item's only window is the hash of all its words."""
    return _winnowed(words) if length == SPAN else tb.gram_hashes(words, length)


def _window_rows(batches):
    """(item, text) -> item, length, print and the two hashes of each window."""
    for batch in batches:
        for first, words, others, rows in _hashed(batch.column(1)):
            sizes = np.bincount(rows)
            for length in range(1, SPAN + 1):
                whole = tb.same_row(rows, length)
                count = len(whole)
                at = np.flatnonzero(whole & (sizes[rows[:count]] == length if length < SPAN else sizes[rows[:count]] >= SPAN))
                if len(at):
                    values = (_prints(words, length)[at], tb.gram_hashes(words, length)[at], tb.gram_hashes(others, length)[at])
                    names = ["item", "length", "print", "hash", "other"]
                    items = batch.column(0).take(pa.array(first + rows[at]))
                    yield pa.RecordBatch.from_arrays([items, pa.array(np.full(len(at), length, np.int32)), *(pa.array(v.view(np.int64)) for v in values)], names=names)


def _contained(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _places(prints: dict[int, np.ndarray | None]):
    """mapInArrow (key, size, text) -> key, size, place, length, print and hashes of windows.

    prints: for each length of the benchmark's windows its fingerprints,
    sorted; windows with another one are left out. None: all stay.
    """

    def run(batches):
        for batch in batches:
            for first, words, others, rows in _hashed(batch.column(2)):
                start = np.searchsorted(rows, rows, side="left")
                for length, table in prints.items():
                    found = _prints(words, length)
                    if table is None:
                        hit = np.ones(len(found), bool)
                    else:
                        # neighbouring windows mostly have the same fingerprint: look each kept one up once
                        fresh = np.ones(len(found), bool)
                        np.not_equal(found[1:], found[:-1], out=fresh[1:])
                        hit = _contained(found[fresh], table)[np.cumsum(fresh) - 1] if len(found) else np.zeros(0, bool)
                    at = np.flatnonzero(hit & tb.same_row(rows, length))
                    if not len(at):
                        continue
                    own = pa.array(first + rows[at])
                    values = (found[at], tb.gram_hashes(words, length)[at], tb.gram_hashes(others, length)[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), pa.array((at - start[at]).astype(np.int32)), pa.array(np.full(len(at), length, np.int32)), *(pa.array(v.view(np.int64)) for v in values)],
                        names=["key", "size", "place", "length", "print", "hash", "other"],
                    )

    return run


def _key(text: Column) -> list[Column]:
    """What tells a text's hits; equal texts have equal ones."""
    return [F.xxhash64(text).alias("key"), F.octet_length(text).alias("size")]


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, size, n_hit, n_items, items_sha256 of the texts with a benchmark window."""
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item is not null and text is not null")
    windows = materialize(items.mapInArrow(_window_rows, "item string, length int, print long, hash long, other long").distinct(), "decontam-windows")
    lengths = [r.length for r in windows.select("length").distinct().collect()]  # SPAN values at most
    distinct = windows.select("length", "print").distinct()
    few = distinct.count() <= SENT_PRINTS
    tables: dict[int, np.ndarray | None] = dict.fromkeys(lengths)
    if few:
        rows = distinct.toPandas()
        tables = {n: np.sort(rows["print"].to_numpy(np.int64)[rows["length"].to_numpy() == n].view(np.uint64)) for n in lengths}
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    places = docs.select(*_key(own), own.alias("text")).mapInArrow(_places(tables), "key long, size int, place int, length int, print long, hash long, other long")
    if not few:
        places = places.join(distinct, ["length", "print"], "left_semi")
    places = places.drop("print").distinct()
    found = materialize(places.join(windows.drop("print"), ["length", "hash", "other"]).select("key", "size", "place", "length", "item"), "decontam-found")
    words = found.select("key", "size", "place", "length").distinct().select("key", "size", F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("word"))
    n_hit = words.distinct().groupBy("key", "size").agg(F.count("*").alias("n_hit"))
    listed = found.select("key", "size", "item").distinct().groupBy("key", "size").agg(F.sort_array(F.collect_list("item")).alias("items"))
    joined = n_hit.join(listed, ["key", "size"])
    whole = joined.select("key", "size", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    whole = materialize(whole, "decontam-hits")
    release(windows, found)
    return whole


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated to ``docs``.

    A window is SPAN consecutive words of an item, or all words of a shorter
    one. A document's word inside any occurrence of a window is hit. Windows
    are told by two 64-bit hashes. Equal texts are hit alike and judged once.

    Null and empty texts have no words and are clean; items without an id or
    words are ignored; an item given twice counts once; an empty benchmark
    leaves every document clean. Columns of ``docs`` that share a result's
    name are replaced by it.
    """
    found = hits(docs, benchmark, text, item, item_text)
    kept = [c for c in docs.columns if c not in RESULT]
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key, size = _key(own)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.regexp_count(own, F.lit(_WORD)).cast("long").alias("n_words"), key.alias("__key"), size.alias("__size"))
    joined = base.join(found.withColumnsRenamed({"key": "__key", "size": "__size"}), ["__key", "__size"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window; what decontaminate says of rows holds here, too."""
    found = hits(docs, benchmark, text, item, item_text).select(F.col("key").alias("__key"), F.col("size").alias("__size"))
    key, size = _key(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    keyed = docs.select("*", key.alias("__key"), size.alias("__size"))
    return keyed.join(found, ["__key", "__size"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), hits AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw USING (l, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
