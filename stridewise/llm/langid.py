"""Language identification by a convolutional network over bytes.

A text's bytes are cut into windows of WINDOW bytes. Filters of several widths
run over embedded bytes, each filter keeps its largest value in the window,
and a softmax over them gives the window's languages. A text's prediction
averages its windows' scores, each by its share of the bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewise.llm import textbytes as tb
from stridewise.llm.common import id_remainder

#: Bytes of a window.
WINDOW = 256
#: Values of an embedded byte, widths of the filters, and filters of each width.
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 5), 12
#: Documents of each language that the network is trained on at most, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 250, 6
#: Languages that are learnt at most: those with the most documents.
LANGUAGES = 500
#: Windows that are scored at a time.
BATCH = 256
#: The prediction for texts without a letter.
UNKNOWN = "und"

_PAD = 256  # the symbol past a text's end


class Network:
    """Embedding, filters and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.name = uuid.uuid4().hex
        embedding = rng.normal(0, 0.5, (257, EMBEDDING))
        embedding[_PAD] = 0
        self.p = {"embedding": embedding}
        for width in WIDTHS:
            self.p[f"filter{width}"] = rng.normal(0, 1 / np.sqrt(width * EMBEDDING), (width * EMBEDDING, FILTERS))
            self.p[f"bias{width}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["out_bias"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _unfold(self, embedded: np.ndarray, width: int) -> np.ndarray:
        """A view of all runs of ``width`` embedded bytes: window, place, width x EMBEDDING."""
        n, length, size = embedded.shape
        a, b, c = embedded.strides
        return np.lib.stride_tricks.as_strided(embedded, (n, length - width + 1, width * size), (a, b, c))

    def _features(self, codes: np.ndarray, places: bool = False):
        embedded = np.ascontiguousarray(self.p["embedding"][codes])
        pooled, at = [], []
        for width in WIDTHS:
            runs = self._unfold(embedded, width)
            n, length, size = runs.shape
            values = np.matmul(runs.reshape(n * length, size), self.p[f"filter{width}"]).reshape(n, length, FILTERS)
            pooled.append(values.max(axis=1) + self.p[f"bias{width}"])
            if places:
                at.append(values.argmax(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1), 0), at, embedded

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Softmax scores of each window."""
        features, _, _ = self._features(codes)
        z = features @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def step(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        features, at, embedded = self._features(codes, places=True)
        z = features @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        n = len(codes)
        loss = -float(np.log(z[np.arange(n), gold] + 1e-9).mean())
        d = z.copy()
        d[np.arange(n), gold] -= 1
        d /= n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = features.T @ d
        grad["out_bias"] = d.sum(axis=0)
        d_features = (d @ self.p["out"].T) * (features > 0)
        for i, width in enumerate(WIDTHS):
            own = d_features[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"bias{width}"] = own.sum(axis=0)
            runs = self._unfold(embedded, width)
            picked = runs[np.arange(n)[:, None], at[i]]  # window, filter, width x EMBEDDING
            grad[f"filter{width}"] = np.einsum("nfk,nf->kf", picked, own)
            back = own[:, :, None] * self.p[f"filter{width}"].T[None]
            for j in range(width):
                np.add.at(grad["embedding"], codes[np.arange(n)[:, None], at[i] + j], back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        grad["embedding"][_PAD] = 0
        return loss, grad

    def train(self, codes: np.ndarray, gold: np.ndarray, steps: int = 260, batch: int = 64, rate: float = 0.01, seed: int = 13) -> float:
        """Adam over random batches with equal shares of the languages; returns the last loss."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(gold == k) for k in range(len(self.languages))]
        by = [b for b in by if len(b)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            at = np.concatenate([b[rng.integers(0, len(b), max(1, batch // len(by)))] for b in by])
            loss, grad = self.step(codes[at], gold[at])
            slope = rate * (1 - step / (steps + 1)) ** 0.5
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.p[k] = (self.p[k] - slope * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rows, bytes) of the windows of texts that lie one after another; short ones are padded."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[:-1][rows] + WINDOW * (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(WINDOW, offsets[1:][rows] - starts)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    codes = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts].astype(np.int16)
    codes[np.arange(WINDOW) >= length[:, None]] = _PAD
    return codes, rows, length


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """A network trained on a bounded sample of rows whose crc32(id as text) mod 3 is not 1.

    The sample: of each language, the SAMPLE_DOCS documents with a letter
    whose ids have the smallest hashes; of each, SAMPLE_WINDOWS windows that
    lie evenly over the text. Rows without a language or text are left out.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    base = base.where("lang is not null and text is not null").where(id_remainder(F.col("id")) != 1)
    base = base.withColumn("hash", F.xxhash64(F.col("id").cast("string")))
    # hashes are spread evenly, so a language's smallest ones lie below a bound that its count gives
    counts = base.groupBy("lang").count()
    bound = F.least(F.lit(2.0**63), F.lit(-(2.0**63)) + F.lit(2.0**64) * (3 * SAMPLE_DOCS + 50) / F.col("count"))
    bounds = {r.lang: r.bound for r in counts.orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang", bound.alias("bound")).collect()}
    if bounds:
        limit = F.coalesce(*[F.when(F.col("lang") == name, F.lit(value)) for name, value in sorted(bounds.items())])
        base = base.where(F.col("hash").cast("double") <= limit)
    small = base.select("lang", "hash", "text").mapInArrow(_sample, "lang string, hash long, windows binary")
    ranked = small.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("hash", "windows"))), 1, SAMPLE_DOCS).alias("docs"))
    codes, gold, languages = [], [], []
    for row in sorted(ranked.collect(), key=lambda r: r.lang):
        for doc in row.docs:
            part = np.frombuffer(doc.windows, np.int16).reshape(-1, WINDOW)
            codes.append(part)
            gold += [len(languages)] * len(part)
        languages.append(row.lang)
    network = Network(languages or [UNKNOWN])
    if len(languages) > 1:
        network.train(np.concatenate(codes), np.array(gold))
    return network


def _sample(batches):
    import heapq

    kept: dict[str, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = kept.setdefault(lang, [])
            if len(own) >= SAMPLE_DOCS and -key <= own[0][0]:
                continue
            if not any(map(str.isalpha, text)):
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            codes, _, _ = windows(data, np.array([0, len(data)]))
            at = np.unique(np.linspace(0, len(codes) - 1, SAMPLE_WINDOWS).round().astype(int))
            item = (-key, codes[at].tobytes())
            if len(own) < SAMPLE_DOCS:
                heapq.heappush(own, item)
            else:
                heapq.heappushpop(own, item)
    rows = [(lang, -key, data) for lang, own in kept.items() for key, data in own]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "hash", "windows"]
    )


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _average(data: np.ndarray, offsets: np.ndarray, network: Network) -> np.ndarray:
    """Mean scores of each text, its windows weighted by their bytes."""
    total = np.zeros((len(offsets) - 1, len(network.languages)))
    codes, rows, length = windows(data, offsets)
    for lo in range(0, len(codes), BATCH):
        np.add.at(total, rows[lo : lo + BATCH], network.scores(codes[lo : lo + BATCH]) * length[lo : lo + BATCH, None])
    return total / np.maximum(1, np.diff(offsets))[:, None]


def predict(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Append lang_pred and score, the mean softmax score of the predicted language.

    Null and empty texts, and texts without a letter, are UNKNOWN with score
    0. Columns of ``docs`` that share a result's name are replaced by it.
    """
    kept = [c for c in docs.columns if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in kept] + RESULT.fields)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        names = np.array(shared.value.languages, object)
        for batch in batches:
            column = batch.column(len(kept))
            found = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            for first, data, offsets in tb.text_slices(column):
                mean = _average(data, offsets, shared.value)
                best = mean.argmax(axis=1)
                sums = np.concatenate([[0], np.cumsum(letters[data])])
                sure = sums[offsets[1:]] > sums[offsets[:-1]]
                for i in np.flatnonzero(~sure).tolist():
                    value = column[first + i].as_py()
                    sure[i] = bool(value) and any(map(str.isalpha, value))
                at = first + np.flatnonzero(sure)
                found[at] = names[best[sure]]
                score[at] = np.clip(mean[np.arange(len(best)), best][sure], 0, 1)
            arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found.tolist(), pa.string()), pa.array(score)], schema=target)

    return base.mapInArrow(run, schema)
