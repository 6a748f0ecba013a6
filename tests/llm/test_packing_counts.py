"""Telling ids are counted over all documents, not over some that a hash picks."""

import numpy as np
from pyspark.sql import functions as F

from stridewise.llm import packing
from stridewise.llm.queries import vocabulary


def test_documents_of_a_rare_word_lie_together_wherever_their_ids_hash_to(spark):
    rows = spark.range(12000).select(F.col("id").alias("doc_id"))
    rare = [r.doc_id for r in rows.orderBy(F.desc(F.xxhash64("doc_id"))).limit(3).collect()]
    docs = rows.withColumn("text", F.when(F.col("doc_id").isin(rare), "the zeppelin").otherwise("the"))
    found = packing.pack_documents(docs, vocabulary()).collect()
    assert len({r.doc_id for r in found}) == 12000
    assert len({r.sequence_id >> 40 for r in found if r.doc_id in rare}) == 1
    assert len({r.sequence_id >> 40 for r in found}) > 1


def test_distinct_ids_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, top, n).astype("<u2") for top, n in ((1, 1), (3, 40), (65536, 500), (200, 3000), (65536, 1))]
    for ids in [*docs, np.zeros(0, "<u2")]:
        term, count = packing._distinct(ids)
        want = np.unique(ids, return_counts=True)
        assert (term == want[0]).all() and (count == want[1]).all()
    assert (packing._frequencies(docs) == sum(np.bincount(np.unique(d), minlength=1 << 16) for d in docs)).all()
