"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewise.llm.common import materialize, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1000003), F.sum(F.xxhash64("dst", "src") % 999983)).first()
    return tuple(row)


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of the links (src, dst), both long.

    component is the smallest node that can be reached. Alternates two star
    contractions (each node's neighbours are hung under the smallest of them,
    first the larger neighbours, then the smaller ones), which reach stars in
    a number of rounds logarithmic in the nodes. Each round is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    edges = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src != dst").distinct()
    edges = materialize(edges, tag)
    before = _state(edges)
    if before[0]:
        while True:
            both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            # written, so that Spark can split a node with very many neighbours: both sides of the joins come straight from a shuffle
            least = materialize(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")), tag)
            # larger neighbours of each node go under its smallest neighbour
            large = materialize(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct(), tag)
            low = materialize(large.groupBy("src").agg(F.min("dst").alias("low")), tag)
            # smaller neighbours, and the node itself, go under the smallest one
            small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*")
            old, edges = edges, materialize(small.where("src != dst").distinct(), tag)
            after = _state(edges)
            release(old, least, large, low)
            if after == before:
                break
            before = after
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
