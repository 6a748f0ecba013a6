"""Near copies: fingerprints find links of their own, and groups leave spanning links only."""

import random

import numpy as np
import pyarrow as pa

from stridewise.llm import simhash


def rows_of(sets):
    """A group of sets, each a component of its own."""
    size = 1 << 10
    marks = []
    for s in sets:
        odd = np.bincount((simhash.tb.mix(s) % np.uint64(size)).astype(np.int64), minlength=size) & 1
        marks.append(np.packbits(odd.astype(np.uint8)).tobytes())
    k = len(sets)
    columns = [np.zeros(k, np.int64), np.zeros(k, np.int64), np.ones(k, np.int64), np.arange(k), np.arange(k), np.array([len(s) for s in sets])]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c) for c in columns), pa.array(marks, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
        names=["hash", "group", "side", "node", "component", "n", "mark", "shingles"],
    )


def test_a_group_of_near_copies_leaves_fewer_links_than_nodes():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = []
    for i in range(60):
        own = base.copy()
        own[i : i + 5] = rng.integers(0, 1 << 63, 5)
        sets.append(np.sort(own))
    sets += [np.sort(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(10)]
    batch = rows_of(sets)
    for size in (7, 100):
        batches = [batch.slice(lo, size) for lo in range(0, len(sets), size)]
        links = [(a, b) for out in simhash._group_links(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        assert len(links) == 59 and {n for link in links for n in link} == set(range(60))
        opened = [n for out in simhash._open_nodes(iter(b.select(range(7)) for b in batches)) for n in out.column("node").to_pylist()]
        assert sorted(opened) == list(range(60))


def test_fingerprints_link_what_no_bucket_of_shingles_holds(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)) for _ in range(12)]
    texts += [t + " end" for t in texts[:8]]
    # one fingerprint, but for sets that do not resemble each other: no link
    texts += ["x " * 400 + "one two three four five", "x " * 400 + "six seven eight nine ten"]

    def no_buckets(cells, levels):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["hash", "node"]) for _ in batches)

    monkeypatch.setattr(simhash, "_buckets", no_buckets)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert [found[12 + i] for i in range(8)] == list(range(8))
    assert all(found[i] == i for i in [*range(12), 20, 21])
