"""Connected components of an edge table by alternating star contractions.

Each task first joins the edges it reads to stars. Each round then hangs the larger neighbours of a node below its smallest one (large star), then all
smaller neighbours (small star); distances shrink by a factor per round. Smallest neighbours are
partial aggregates and the joins are equi-joins, so a hub holding a third of all edges is split
by the engine (map-side combine, skew join) and no neighbour list is ever collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import materialise


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


_HELD_EDGES = 1 << 20


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task joins the edges it reads (some at a time) and hands on a star for each part."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        def stars():
            rows = [(x, root(x)) for x in parent]
            rows = [r for r in rows if r[0] != r[1]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent.setdefault(min(a, b), min(a, b))
                    parent[max(a, b)] = min(a, b)
            if len(parent) > _HELD_EDGES:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna().mapInArrow(run, "u long, v long")


def _is_star_forest(state: DataFrame) -> bool:
    """Whether every node hangs below one centre and no centre hangs below another."""
    ends = state.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` to ``(node, label)``: the smallest node of each component, one row per
    node on an edge. Null ends and self-loops are dropped; no edges give no rows."""
    state = materialise(_canonical(_contracted(edges.select("u", "v"))), "edges")
    while not _is_star_forest(state):
        # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours are linked to the smallest of these
        large = materialise(_canonical(large), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        state = materialise(_canonical(nxt), "edges")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(node, label)`` after more edges: only the new edges are contracted, between labels."""
    end = labels.select(F.col("node").alias("u"), F.col("label").alias("_u"))
    other = labels.select(F.col("node").alias("v"), F.col("label").alias("_v"))
    between = edges.join(end, "u", "left").join(other, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    merged = materialise(components(between), "merged")
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select(
        "node", F.coalesce("_to", "label").alias("label"))
    return moved.unionByName(merged.join(labels.select("node"), "node", "left_anti"))
