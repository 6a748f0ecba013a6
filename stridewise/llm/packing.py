"""Packing of token sequences with lexically related documents.

Documents are put in the order of their most telling ids and cut into shards of
about SHARD_TOKENS ids: so documents on one matter lie in one shard, wherever
they come from. Which ids are telling, and BM25, is counted over all of them. Each shard has an
inverted index over its ids. A seed document opens a window; the
best of its unused neighbours fill it greedily. The document that overflows is
cut there, and its rest opens the next window. What is left in the end goes
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewise.llm import wordbpe
from stridewise.llm.common import materialize, trim
from stridewise.shipping import partitions

#: Ids of a sequence at most, and the id behind each document.
WINDOW, END_ID = 4096, 2
#: Ids in a shard, which one task holds; the document that reaches it is the shard's last.
SHARD_TOKENS = 1 << 20
#: BM25's saturation of term counts and weight of document lengths.
K1, B = 1.2, 0.75
#: Ids of a document by which it is put in order; documents that have such an id at least, and the part of all that have it at most.
TELLING, TELLING_LEAST, TELLING_PART = 3, 3, 0.1


@dataclass
class Corpus:
    """Documents, ids in them, and documents that have each id."""

    documents: int
    tokens: int
    frequency: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray]) -> Corpus:
        return Corpus(len(docs), sum(map(len, docs)), _frequencies(docs))


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs; 16-bit numbers are sorted by their digits, which is far faster than np.unique."""
    ids = np.sort(ids.astype(np.uint16, copy=False), kind="stable")
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[head], np.diff(np.append(head, len(ids)))


def _frequencies(docs: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate([_distinct(d)[0] for d in docs]), minlength=1 << 16)


def telling(ids: np.ndarray, corpus: Corpus) -> int:
    """The TELLING ids that weigh most in a document, the first one highest, as one number."""
    term, count = _distinct(ids)
    frequency = corpus.frequency[term]
    some = (frequency >= TELLING_LEAST) & (frequency <= TELLING_PART * corpus.documents)
    weight = np.log(corpus.documents / frequency[some]) * (count[some] / (count[some] + K1))
    best = term[some][np.argsort(-weight, kind="stable")[:TELLING]]
    return sum(int(t) << (16 * (TELLING - 1 - i)) for i, t in enumerate(best))


class Index:
    """BM25 weights of a shard's documents, by id; frequencies and the mean length are those of the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        self.n = len(docs)
        key = (np.repeat(np.arange(self.n, dtype=np.int64), lengths) << 16) | np.concatenate(docs).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        owner, term = key >> 16, (key & 0xFFFF).astype(np.uint16)
        own = np.bincount(term, minlength=1 << 16)
        # an id that half of the documents have says nothing: its weight would be 0 or less
        idf = np.maximum(0, np.log((corpus.documents - corpus.frequency + 0.5) / (corpus.frequency + 0.5)))
        some = idf[term] > 0
        owner, term, count = owner[some], term[some], count[some]
        own[idf == 0] = 0
        self.terms_from = np.searchsorted(owner, np.arange(self.n + 1))
        self.terms = term
        stretch = K1 * (1 - B + B * lengths / max(1.0, corpus.tokens / max(1, corpus.documents)))
        weight = idf[term] * count * (K1 + 1) / (count + stretch[owner])
        order = np.argsort(term, kind="stable")
        self.posting_doc = owner[order].astype(np.int32)
        self.posting_weight = weight[order]
        self.posting_from = np.concatenate([[0], np.cumsum(own)])

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share an id with ``doc``, best first; ties by place."""
        terms = self.terms[self.terms_from[doc] : self.terms_from[doc + 1]]
        start, stop = self.posting_from[terms], self.posting_from[terms.astype(np.int64) + 1]
        size = stop - start
        if not size.sum():
            return np.zeros(0, np.int64)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        score = np.bincount(self.posting_doc[at], self.posting_weight[at], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], corpus: Corpus | None = None) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(sequence length, [(document, start, length)]) for documents given as arrays of ids."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    cursor, out = 0, []
    rest: tuple[int, int] | None = None  # a cut document and the place of its rest
    while True:
        window: list[tuple[int, int, int]] = []
        space = WINDOW
        while space:
            if rest is None:
                while cursor < len(docs) and not unused[cursor]:
                    cursor += 1
                if cursor == len(docs):
                    break
                rest = (cursor, 0)
                unused[cursor] = False
            seed, start = rest
            length = min(space, len(docs[seed]) - start)
            window.append((seed, start, length))
            space -= length
            rest = (seed, start + length) if start + length < len(docs[seed]) else None
            if not space:
                break
            for doc in index.neighbours(seed, unused).tolist():
                length = min(space, len(docs[doc]))
                window.append((doc, 0, length))
                unused[doc] = False
                space -= length
                if length < len(docs[doc]):
                    rest = (doc, length)
                if not space:
                    break
        if space:
            return out + list(_powers_of_two(window))
        out.append((WINDOW, window))


def _powers_of_two(pieces: list[tuple[int, int, int]]):
    """The pieces cut into sequences whose lengths are powers of two, longest first."""
    total = sum(length for _, _, length in pieces)
    pieces = pieces[::-1]
    while total:
        size = room = 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while room:
            doc, start, length = pieces.pop()
            taken = min(room, length)
            sequence.append((doc, start, taken))
            room -= taken
            if taken < length:
                pieces.append((doc, start + taken, length - taken))
        yield size, sequence


RESULT = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("sequence_length", T.LongType()),
    ]
)


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, RESULT's columns and, if asked for, the piece's ``ids``.

    Every id of a document's ids plus END_ID lies in exactly one piece; the
    offsets of a sequence's pieces leave no gap. vocabulary: the tokenizer
    file, at the same path on every machine. A sequence's number holds its
    partition's in the upper bits.

    Null and empty texts have END_ID alone; null and repeated ids are packed
    like others; an empty table gives no piece. Other columns are not read.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    tokens = T.StructType([base.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    written = materialize(base.mapInArrow(_tokenized(vocabulary), tokens), "packing-tokens")
    shared = docs.sparkSession.sparkContext.broadcast(_corpus(written))
    keyed = written.mapInArrow(_keyed(shared), T.StructType([*tokens.fields, T.StructField("key", T.LongType())]))
    # documents of one key can be dealt to several partitions: by what else tells them apart
    rest = F.xxhash64("doc_id", F.octet_length("ids"))
    ordered = keyed.withColumn("rest", rest).repartitionByRange(partitions(docs), "key", "rest").sortWithinPartitions("key", "rest").select("doc_id", "ids")
    schema = T.StructType([base.schema["doc_id"]] + RESULT.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    return ordered.mapInArrow(_packed(shared, schema, with_ids), schema)


def _corpus(tokens: DataFrame) -> Corpus:
    """Counts over documents given by their ids; at most one row for each id of the vocabulary comes to the driver."""
    counts = tokens.select("doc_id", "ids").mapInArrow(_counted, "term int, n long, documents long, tokens long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).collect()
    corpus = Corpus(0, 0, np.zeros(1 << 16, np.int64))
    for r in counts:
        corpus.frequency[r.term] = r.n
        corpus.documents += r.documents
        corpus.tokens += r.tokens
    return corpus


def _tokenized(vocabulary: str):
    """mapInArrow (doc_id, text) -> doc_id, its ids and END_ID as 16-bit numbers."""

    def run(batches):
        bpe = wordbpe.load(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.append(bpe.ids(value or ""), np.uint16(END_ID)).astype("<u2").tobytes() for value in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        trim()

    return run


def _keyed(corpus):
    """mapInArrow (doc_id, ids) -> the same and the document's telling ids by the counts over all documents."""

    def run(batches):
        for batch in batches:
            keys = [telling(x, corpus.value) for x in _ids(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "ids", "key"])

    return run


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), "<u2") for value in column]


def _counted(batches):
    """(doc_id, ids) -> term, documents of this task that have it; in the row of END_ID, which all have, the task's documents and ids."""
    total = np.zeros(1 << 16, np.int64)
    documents = tokens = 0
    for batch in batches:
        if batch.num_rows:
            docs = _ids(batch.column(1))
            total += _frequencies(docs)
            documents += len(docs)
            tokens += sum(map(len, docs))
    at = np.flatnonzero(total)
    first = at == END_ID
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(np.where(first, documents, 0)), pa.array(np.where(first, tokens, 0))], names=["term", "n", "documents", "tokens"])


def _packed(shared, schema: T.StructType, with_ids: bool):
    """mapInArrow (doc_id, ids) -> pieces, shard by shard."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 40
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def shard():
            nonlocal number
            columns: list[list] = [[] for _ in target]
            for length, pieces in pack(held, shared.value):
                offset = 0
                for doc, start, count in pieces:
                    ids = held[doc][start : start + count]
                    row = [names[doc], start, count, zlib.crc32(ids.astype("<u4").tobytes()), len(held[doc]), number, offset, length]
                    for column, value in zip(columns, row + ([ids.astype(np.int32)] if with_ids else []), strict=True):
                        column.append(value)
                    offset += count
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1)), strict=True):
                held.append(ids.copy())
                names.append(name)
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield shard()
                    names, held, size = [], [], 0
        if held:
            yield shard()

    return run
