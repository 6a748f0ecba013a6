"""Quality rules as a short-circuit cascade of Spark expressions.

On a sample, each rule's cost (time of a run that evaluates it alone, less that
of an empty run) and selectivity (share of rows it rejects) are estimated.
Rules are then tried by falling rejection per cost in nested conditions that
hold the rules' measures themselves: what a rule needs is computed only for
rows that no rule before it has rejected. The order bears on the time alone;
whether a row is kept is the same for every order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewise.llm.chat import bound
from stridewise.llm.common import materialize, release

#: Rows, about, that costs and selectivities are estimated on, and runs of each rule, of which the fastest counts.
SAMPLE_ROWS, RUNS = 5000, 3
#: Words of a window in which repetition is looked for.
SPAN = 8
#: What separates words.
_SPACE = r"[\x20\x09-\x0D]+"

#: Gives the column of a measure by its name.
Measures = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A condition over measures under which a text is rejected."""

    name: str
    rejects: Callable[[Measures], Column]


#: The base rules, by which base_failed is defined.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: All rules of the cascade.
RULES = (
    *BASE,
    Rule("symbols", lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("few_distinct_words", lambda m: 100 * m("n_distinct_words") < 10 * m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: one for each window, in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twice), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(SPAN), F.coalesce(F.get(p, j + 1) - x, F.lit(SPAN))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(bound(pairs, starts), covered))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        places = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(1), F.size(hashes) - (SPAN - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(SPAN))))

    return F.coalesce(bound(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), _repeated), F.lit(0).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


#: A measure of a text, from the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.char_length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    "n_lines": lambda text, words: F.size(_lines(text)).cast("long"),
    "n_dup_lines": lambda text, words: bound(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_distinct_words": lambda text, words: F.size(F.array_distinct(words)).cast("long"),
    "n_repeat_words": lambda text, words: _repeat_words(words),
}
#: The measures that a report on every text shows.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def measure(docs: DataFrame, names: tuple[str, ...] = tuple(MEASURES), text: str = "text") -> DataFrame:
    """Append measures of every text; columns of the same names are replaced.

    n_words, word_chars (code points), n_symbols, n_lines (with a word),
    n_dup_lines, n_distinct_words and n_repeat_words (in windows of SPAN words
    found twice or more; windows are compared by 64-bit hashes). Null and
    empty texts measure 0 throughout.
    """
    full = docs.withColumn("__text", _text(text)).withColumn("__words", _words(F.col("__text")))
    full = full.withColumns({n: MEASURES[n](F.col("__text"), F.col("__words")) for n in names})
    return full.drop("__text", "__words")


def _at_hand(have: tuple[str, ...], text: str) -> Measures:
    """Measures from columns, if they are there, else from the text where they are asked for."""
    return lambda name: F.col(name) if name in have else MEASURES[name](_text(text), _words(_text(text)))


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, have: tuple[str, ...] = (), text: str = "text") -> list[Rule]:
    """The rules by falling rejection per cost, estimated on about SAMPLE_ROWS rows, drawn with a fixed seed.

    have: measures that the judged rows bring along, which thus cost nothing.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    drawn = docs.select(F.col(f"`{text}`").alias("text")).sample(share, seed=17).repartition(8)
    sample = materialize(measure(drawn, have), "quality-sample")

    def run(rejects: Column) -> tuple[float, int]:
        times, rejected = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = sample.select(F.count_if(rejects)).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), rejected

    empty, _ = run(F.col("text").isNull())
    worth = []
    for i, rule in enumerate(rules):
        seconds, rejected = run(rule.rejects(_at_hand(have, "text")))
        worth.append((-rejected / max(1e-3, seconds - empty), i))
    release(sample)
    return [rules[i] for _, i in sorted(worth)]


def judge(docs: DataFrame, rules: list[Rule], have: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Append base_failed, kept (no rule rejects) and rejected_by, the first rule of the given order that does.

    have: measures that are columns of ``docs``; the others are computed
    inside the conditions of the rules that ask for them, for rows that come so
    far. Columns of the results' names are replaced.
    """
    at_hand = _at_hand(have, text)
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.rejects(at_hand), F.lit(rule.name)).otherwise(first)
    judged = docs.withColumn("rejected_by", first)
    base = [r.name for r in BASE]
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | rule.rejects(at_hand)
    # a base rule that decided tells; else ask them
    judged = judged.withColumn("base_failed", F.when(F.col("rejected_by").isin(base), F.lit(True)).when(F.col("rejected_by").isNull() & F.lit(set(BASE) <= set(rules)), F.lit(False)).otherwise(failed))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), rows AS (SELECT row_number() OVER () AS r, * FROM d),
g AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM rows WHERE len(w) >= 8)
), twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM rows LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * n_distinct < 10 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""
