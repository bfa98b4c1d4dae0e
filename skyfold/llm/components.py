"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.session import written_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the ``(a, b)`` links; the component is its smallest node.

    Every round hangs larger neighbours on the smallest one, then smaller ones likewise, until all edges point to
    roots: about log(nodes) rounds, each written so that its lineage ends. Minima are combined before they are
    exchanged and the joins have one row per node on one side, so a node with most of all links can be split.
    """
    edges = written_table(_downward(links.selectExpr("a AS u", "b AS v")))
    state = _state(edges)
    while True:
        edges = written_table(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.selectExpr("u AS node", "v AS component").union(edges.selectExpr("v AS node", "v AS component").distinct())


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return _downward(both.join(smallest, "u").where("v > u").selectExpr("v AS u", "m AS v"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").selectExpr("v AS u", "m AS v")
    return _downward(moved.unionByName(smallest.selectExpr("u", "m AS v")))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]
