"""Connected components by alternating large-star and small-star steps, as joins and minima.

Each step links nodes to the least neighbour they know, so components become stars around their least node. Every
step is a partial minimum per node and a join, never a list of a node's neighbours; rounds end in written tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import new_path, remove, written


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: pairs of ids. Gives (node, component) for every node that is linked, component its least node; the least
    nodes themselves are rows too. Null ids and links of a node to itself link nothing."""
    spark = links.sparkSession
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    edges = written(edges, path=(path := new_path(spark)))
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, path=(between := new_path(spark)))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, path=(after := new_path(spark)))
        remove(spark, path)
        remove(spark, between)
        edges, path, old = small, after, state
        state = _state(edges)
        if state == old:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free hash: equal when a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: each node of a group beside the group's first, as (first, node)."""
    of = np.full(len(linked), -1)
    for k in range(len(linked)):
        if of[k] < 0:
            of[k] = k
            edge = np.array([k])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & (of < 0))
                of[edge] = k
    node = np.flatnonzero(of != np.arange(len(of)))
    return of[node], node
