"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares two words by the (gapped) subsequences of three and four
characters that they share; each skipped character costs a factor GAP. Words
with inserted or missing characters thus stay close to the insult they hide.

Training sees labelled texts as bags of words: a clean text has none that
insults, a toxic one has at least one. The words that are more typical of toxic
texts than chance makes any word start as the positive ones; then SVM and
choice of words alternate. A text without such a word is taken for a wrong label.

A decision value over Nyström landmarks, sum_j alpha_j k(x, l_j) + b, is
linear in x's subsequence features. The landmarks are therefore folded into
one weight per subsequence, and scoring costs no more with more landmarks.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewise.llm import textbytes as tb
from stridewise.llm.common import id_remainder, trim, worker_memory

#: Labelled rows of each kind that the classifier is fitted on at most, and distinct words of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 900, 1800, 4000
#: Factor for each skipped character, and characters that may be skipped.
GAP, SKIPS = 0.6, 2
#: Landmarks of the Nyström approximation.
LANDMARKS = 256
#: Characters of the longest string that is compared as a whole; longer ones are cut into overlapping windows.
LONGEST = 24
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
#: Words that a worker remembers the margins of.
REMEMBERED = 150_000
#: Words whose margins are computed together; a worker needs about 12 KB for each.
TOGETHER = 512
#: Times that the words of clean texts are tried against each other, for what chance reaches.
CHANCE = 5
#: Margin of a text without words.
NOTHING = -3.0

_IS_WORD = tb.byte_class((0x20, 0x20), (0x09, 0x0D))
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = ".,;:!?\"'()[]{}<>|$%&*#@=+-_/"
_INNER = re.compile(r"[\W_]+")
_ORDERS = (3, 4)


def _steps(order: int) -> list[tuple[tuple[int, ...], float]]:
    """Offsets of the characters of a subsequence, each with its weight."""
    out = []
    for span in range(order, order + SKIPS + 1):
        for inner in combinations(range(1, span - 1), order - 2):
            out.append(((0, *inner, span - 1), GAP ** (span - order)))
    return out


_STEPS = [(step, weight) for order in _ORDERS for step, weight in _steps(order)]
#: Features: five bits a character, order 4 after order 3.
_FEATURES = (1 << 15) + (1 << 20)


def _code_table() -> np.ndarray:
    """Five-bit codes of the characters of the basic plane: 1 to 26, four classes of other letters, 31 for the rest."""
    table = np.full(1 << 16, 31, np.int32)
    for point in range(1 << 16):
        char = chr(point)
        if "a" <= char <= "z":
            table[point] = point - 96
        elif char.isalpha():
            table[point] = 27 + point % 4
    table[0] = 0
    return table


_CODES: list[np.ndarray] = []


def encode(words: list[str]) -> np.ndarray:
    """Character codes, a row for each word of at most LONGEST characters, 0 behind its end."""
    if not _CODES:
        _CODES.append(_code_table())
    width = max(map(len, words), default=1)
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    out = np.zeros((len(words), width + max(_ORDERS) + SKIPS), np.int32)
    out[:, :width] = _CODES[0][np.minimum(points, 0xFFFF)]
    return out


def _entries(codes: np.ndarray):
    """For each kind of subsequence, its feature at each start (_FEATURES: past the end) and its weight."""
    width = codes.shape[1] - max(_ORDERS) - SKIPS
    for step, weight in _STEPS:
        feature = codes[:, :width]
        for offset in step[1:]:
            feature = (feature << 5) | codes[:, offset : offset + width]
        if len(step) == 4:
            feature = feature + (1 << 15)
        yield np.where(codes[:, step[-1] : step[-1] + width] > 0, feature, _FEATURES), weight


_STEP_WEIGHTS = np.array([weight for _, weight in _STEPS], np.float32)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Length of each word's feature vector, the root of k(x, x)."""
    packed = np.concatenate([(feature << 5) | i for i, (feature, _) in enumerate(_entries(codes))], axis=1)
    packed.sort(axis=1)
    feature = packed >> 5
    weight = np.where(feature < _FEATURES, _STEP_WEIGHTS[packed & 31], np.float32(0)).ravel()
    head = np.ones(packed.shape, bool)
    np.not_equal(feature[:, 1:], feature[:, :-1], out=head[:, 1:])
    at = np.flatnonzero(head)
    sums = np.add.reduceat(weight, at)
    return np.sqrt(np.maximum(np.bincount(at // packed.shape[1], sums * sums, len(codes)), 1e-9))


def candidates(token: str) -> list[str]:
    """The strings to compare for a token: whole, without inner marks, its parts, windows of a long one."""
    token = token.lower().strip(_MARKS)
    if token.isalpha() and len(token) <= LONGEST:
        return [token] if len(token) >= 3 else []
    token = _EDGES.sub("", token)
    found = [token]
    if _INNER.search(token):
        parts = _INNER.split(token)
        found += ["".join(parts), *[p for p in parts if len(p) >= 3]]
    out = []
    for text in found:
        if len(text) <= LONGEST:
            out.append(text)
        else:
            out += [text[i : i + LONGEST] for i in range(0, len(text) - LONGEST // 2, LONGEST // 2)]
    return list(dict.fromkeys(x for x in out if len(x) >= 3))


@dataclass
class Model:
    """Weights of subsequences, the bias, and the scale that makes scores of margins."""

    weights: np.ndarray  # one more than the features: 0 for what lies past a word's end
    bias: float
    middle: float = 0.0
    slope: float = 4.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of strings of at most LONGEST characters."""
        out = np.empty(len(words), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo in range(0, len(words), TOGETHER):
            at = order[lo : lo + TOGETHER]
            codes = encode([words[i] for i in at])
            total = np.zeros(len(codes), np.float32)
            for feature, weight in _entries(codes):
                total += np.float32(weight) * self.weights[feature].sum(axis=1)
            out[at] = total / _norms(codes) + self.bias
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the margin that parts the classes best."""
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins - self.middle) + shift, -30, 30)))


def _kernel(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k(words, landmarks), and the landmarks' features: places in the weights and their values."""
    codes = encode(landmarks)
    norm = _norms(codes)
    place, row, value = [], [], []
    for feature, weight in _entries(codes):
        at = np.nonzero(feature < _FEATURES)
        place.append(feature[at])
        row.append(at[0])
        value.append(weight / norm[at[0]])
    place, row, value = np.concatenate(place), np.concatenate(row), np.concatenate(value)
    known, column = np.unique(place, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row: unknown features
    np.add.at(table, (column, row), value)
    lookup = np.full(_FEATURES + 1, len(known), np.int32)  # features of no landmark: past the table
    lookup[known] = np.arange(len(known))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 512):
        codes = encode(words[lo : lo + 512])
        part = np.zeros((len(codes), len(landmarks)), np.float32)
        for feature, weight in _entries(codes):
            found = lookup[feature]
            r, c = np.nonzero(found < len(known))
            if len(r):
                head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                part[r[head]] += np.float32(weight) * np.add.reduceat(table[found[r, c]], head, axis=0)
        out[lo : lo + 512] = part / _norms(codes)[:, None]
    return out, known, table[:-1]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps; weight: of each row."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    weight = weight / weight.sum()
    for _ in range(30):
        slack = 1 - y * (x @ w)
        active = slack > 0
        xa, wa = x[active], weight[active]
        gradient = ridge * w - 2 * xa.T @ (wa * y[active] * slack[active])
        hessian = np.diag(ridge) + 2 * xa.T @ (wa[:, None] * xa)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _garbled(word: str, rng: np.random.Generator) -> list[str]:
    """The word with one inserted or doubled character, three times."""
    out = []
    if 4 <= len(word) < LONGEST:
        for _ in range(3):
            at = int(rng.integers(1, len(word)))
            mark = word[at - 1] if rng.random() < 0.4 else "*-._x1"[int(rng.integers(6))]
            out.append(word[:at] + mark + word[at:])
    return out


def _fold(words: list[str], labels: np.ndarray, weight: np.ndarray) -> Model:
    """Nyström map, SVM, and the landmarks folded into weights of subsequences.

    Landmarks are the weightiest words of either label.
    """
    order = np.argsort(-weight, kind="stable")
    half = LANDMARKS // 2
    chosen = [words[i] for i in [*order[labels[order] > 0][:half], *order[labels[order] < 0][:half]]]
    k, known, table = _kernel([*words, *chosen], chosen)
    mm = k[len(words) :].astype(np.float64)
    value, vector = np.linalg.eigh((mm + mm.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    w, bias = _svm(k[: len(words)] @ root, labels.astype(float), weight)
    weights = np.zeros(_FEATURES + 1, np.float32)
    weights[known] = table @ (root @ w)
    return Model(weights, bias)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The character 4- and 5-grams of each word: its distinct ones by number, side by side, where each word's begin and end, and how many there are."""
    known: dict[str, int] = {}
    found, ends = array("i"), [0]
    for w in words:
        found.extend({known.setdefault(w[i : i + n], len(known)) for n in (4, 5) for i in range(len(w) - n + 1)})
        ends.append(len(found))
    return np.array(found, np.int32), np.array(ends), len(known)


def _ratios(in_toxic: np.ndarray, in_clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of each gram that toxic texts have much more often than clean ones, else 0, given the texts of either kind that have it."""
    n_toxic, n_clean = max(1, n_toxic), max(1, n_clean)
    known: dict[tuple[int, int], float] = {}

    def ratio(a: int, b: int) -> float:
        p, q, r = a / n_toxic, b / n_clean, (a + b) / (n_toxic + n_clean)
        if p <= 12 * q or a < 2:
            return 0.0
        part = lambda k, n, x: (k * math.log(x) if k else 0) + ((n - k) * math.log(1 - x) if k < n else 0)
        return 2 * (part(a, n_toxic, p) + part(b, n_clean, q) - part(a, n_toxic, r) - part(b, n_clean, r))

    out = np.zeros(len(in_toxic))
    for gram in np.flatnonzero(in_toxic).tolist():
        pair = (int(in_toxic[gram]), int(in_clean[gram]))
        if pair not in known:
            known[pair] = ratio(*pair)
        out[gram] = known[pair]
    return out


def _typical(bags: list[list[str]], toxic: np.ndarray, rng: np.random.Generator) -> tuple[dict[str, float], float]:
    """How typical each word is of toxic bags, and the value that chance alone reaches.

    A word's value is the best ratio of its grams. Chance is the most that a gram
    of clean bags reaches against the other clean ones when CHANCE times some of
    them, as large a part as the toxic ones are of all, are called toxic: so it
    knows how many grams are tried, and that texts of one language share theirs.

    Grams are numbers in flat arrays: as sets of texts, those of a sample would
    take hundreds of megabytes of the driver.
    """
    place: dict[str, int] = {}
    for bag in bags:
        for w in bag:
            place.setdefault(w, len(place))
    grams, bounds, n_grams = _grams(list(place))
    texts = []
    for bag in bags:
        own = [grams[bounds[i] : bounds[i + 1]] for i in map(place.__getitem__, bag)]
        texts.append(np.unique(np.concatenate([np.zeros(0, np.int32), *own])))

    def having(chosen: np.ndarray) -> np.ndarray:
        """Of each gram, the chosen texts that have it."""
        counts = np.zeros(n_grams, np.int64)
        for i in np.flatnonzero(chosen).tolist():
            counts[texts[i]] += 1
        return counts

    in_clean = having(~toxic)
    value = np.append(_ratios(having(toxic), in_clean, int(toxic.sum()), int((~toxic).sum())), 0.0)
    best_of = [float(value[grams[a:b]].max(initial=0.0)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    clean = np.flatnonzero(~toxic)
    called = round(len(clean) * float(toxic.mean()))
    best = []
    for _ in range(CHANCE if called else 0):
        drawn = np.zeros(len(bags), bool)
        drawn[clean[rng.choice(len(clean), called, replace=False)]] = True
        in_drawn = having(drawn)
        best.append(float(_ratios(in_drawn, in_clean - in_drawn, called, len(clean) - called).max(initial=0.0)))
    return dict(zip(place, best_of, strict=True)), max(best, default=0.0)


def fit(bags: list[list[str]], toxic: np.ndarray, rounds: int = 2, seed: int = 7) -> Model:
    """A model from the words of labelled texts. Without both labels every text scores as clean.

    A toxic text brings in the words that are beyond chance, in the second round
    those of positive margin; one that has none brings in nothing.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(_FEATURES + 1, np.float32), NOTHING)
    rng = np.random.default_rng(seed)
    strings = {word: [sys.intern(c) for c in candidates(word)] for bag in bags for word in bag}
    bags = [list(dict.fromkeys(c for word in bag for c in strings[word])) for bag in bags]
    del strings
    value, least = _typical(bags, toxic, rng)
    clean_words = sorted({w for bag, t in zip(bags, toxic, strict=True) if not t for w in bag})
    vocabulary = sorted({w for bag in bags for w in bag})
    # wrong labels put insults into clean texts, too: words of clean texts that are typical of toxic ones do not count as clean
    clean = {w for w in clean_words if value[w] <= least}
    model = Model(np.zeros(_FEATURES + 1, np.float32), NOTHING)
    for _ in range(rounds):
        # of each toxic text, the word that speaks for it most and those that do so half as much, counted over the texts
        witness = Counter()
        for bag, t in zip(bags, toxic, strict=True):
            own = [w for w in bag if t and w not in clean and value[w] > least]
            most = max((value[w] for w in own), default=0.0)
            witness.update(w for w in own if 2 * value[w] >= most)
        if not witness:
            break
        plain = sorted(clean)
        hard = sorted(plain, key=lambda w: (-value[w], w))[:1500]
        drawn = [plain[i] for i in rng.choice(len(plain), min(4000, len(plain)), replace=False)] if plain else []
        negative = list(dict.fromkeys([*hard, *drawn]))
        positive = sorted(witness)
        share = {w: float(n) for w, n in witness.items()}
        total = sum(share.values())
        garbled = [(g, share[w]) for w in positive for g in _garbled(w, rng)]
        words = [*positive, *(g for g, _ in garbled), *negative]
        labels = np.array([1] * (len(positive) + len(garbled)) + [-1] * len(negative))
        weight = np.array([share[w] / total for w in positive] + [n / (3 * total) for _, n in garbled] + [2 / max(1, len(negative))] * len(negative))
        model = _fold(words, labels, weight)
        value = dict(zip(vocabulary, model.margins(vocabulary).tolist(), strict=True))
        least = 0.0
    best = np.array([max((value[w] for w in bag), default=NOTHING) for bag in bags])
    model.middle, model.slope = _scale(best, toxic)
    return model


def _scale(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The margin that parts the bags with the least error of either kind, in the middle of its gap, and a slope."""
    order = np.argsort(best)
    y = toxic[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    false = (np.sum(~y) - np.concatenate([[0], np.cumsum(~y)])) / max(1, np.sum(~y))
    cost = missed + 3 * false
    low = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate([[best.min() - 1], best[order], [best.max() + 1]])
    at = low[np.argmax(edges[low + 1] - edges[low])]
    width = max(edges[at + 1] - edges[at], 0.1)
    return float((edges[at] + edges[at + 1]) / 2), float(np.clip(6 / width, 4, 20))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows of which crc32(id as text) mod 3 is not 1.

    The sample: of either label, the SAMPLE_* documents whose ids have the
    smallest hashes; of each, at most SAMPLE_WORDS distinct words. An id with
    several labels counts as toxic if any is, and of several texts of an id the
    one with the smallest hash is taken; null ids and labels are left out.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marks = marks.where(id_remainder(F.col("id")) != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    few = lambda kind, n: marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = few(1, SAMPLE_TOXIC).unionByName(few(0, SAMPLE_CLEAN))
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # the sample has SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    drawn = base.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = drawn.select("toxic", "text").mapInArrow(_bags, "toxic int, words string").collect()
    rows.sort(key=lambda r: (r.toxic, zlib.crc32(r.words.encode()), r.words))
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    # a word of many texts is held once; the driver's memory is as bounded as the executors'
    bags = [[*map(sys.intern, r.words.split("\n"))] if r.words else [] for r in rows]
    del rows
    model = fit(bags, toxic)
    del bags
    trim()
    return model


def _bags(batches):
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            words = {w for w in (text or "").lower().split() if len(w) >= 3}
            if len(words) > SAMPLE_WORDS:
                words = set(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:SAMPLE_WORDS])
            out.append("\n".join(sorted(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["toxic", "words"])


def _text_margins(column: pa.Array, model: Model) -> np.ndarray:
    """The largest margin of any word of each text."""
    memory = worker_memory(f"toxicity-{model.name}")
    out = np.full(len(column), NOTHING)
    for first, raw, offsets in tb.text_slices(column):
        data = tb.LOWER[raw]
        starts, ends, rows = tb.word_bounds(data, offsets, _IS_WORD)
        if not len(starts):
            continue
        text = data.tobytes()
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        # runs of three or more one-character words are one spelt-out word
        short = np.concatenate([[False], ends - starts == 1, [False]])
        change = np.concatenate([[True], rows[1:] != rows[:-1]])
        lo = np.flatnonzero(short[1:-1] & (~short[:-2] | change))
        hi = np.flatnonzero(short[1:-1] & (~short[2:] | np.append(change[1:], True))) + 1
        for a, b in zip(lo[hi - lo >= 3].tolist(), hi[hi - lo >= 3].tolist(), strict=True):
            words.append(b"".join(words[a:b]))
            rows = np.append(rows, rows[a])
        fresh = [w for w in set(words) if w not in memory]
        if fresh:
            if len(memory) + len(fresh) > REMEMBERED:
                memory.clear()
                fresh = list(set(words))
            place: dict[str, int] = {}
            of, owner = [], []
            for i, word in enumerate(fresh):
                for c in candidates(word.decode("utf-8", "replace")):
                    of.append(place.setdefault(c, len(place)))
                    owner.append(i)
            best = np.full(len(fresh), NOTHING)
            if place:
                np.maximum.at(best, np.array(owner), model.margins(list(place))[np.array(of)])
            memory.update(zip(fresh, best.tolist(), strict=True))
        values = np.fromiter(map(memory.__getitem__, words), np.float64, len(words))
        np.maximum.at(out, first + rows, values)
    return out


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 from THRESHOLD on) to ``docs``.

    A text's score is that of its most insulting word. Null and empty texts,
    and texts of words under three characters, get the lowest score. Columns
    of ``docs`` that share a result's name are replaced by it.
    """
    kept = [c for c in docs.columns if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in kept] + RESULT.fields)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            found = shared.value.scores(_text_margins(batch.column(len(kept)), shared.value))
            arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(kept))]
            arrays += [pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
        trim()

    return base.mapInArrow(run, schema)
