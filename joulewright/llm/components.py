"""Connected components of a large edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulewright.llm.common import drop_tables, collected, materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root of every node that an edge (a, b) names; a component's nodes share a root, one of them.

    Each round hooks every vertex to the first of itself and its neighbours, in an order by a
    hash that is another one in each round, then once more to what that one is hooked to, and
    renames the edges by it; edges within a vertex vanish. In such an order only a share of
    the vertices is first among its neighbours, whatever the ids and the shape (a chain in
    order of its ids as well as a star), so rounds grow with the logarithm of the longest
    path. A round's firsts are aggregated before the shuffle, so a vertex with any number of
    edges costs one row a task; nothing is collected but whether edges are left. The edges
    and the names are written once a round, which cuts their lineage, and the tables of the
    round before are deleted. Edges to a null are ignored.
    """
    spark = edges.sparkSession
    with collected() as old:
        left = materialize(edges.select("a", "b").where("a != b").distinct(), label)
        names = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), label)
    number = 0
    while left.take(1):
        with collected() as new:
            left, names = contract(left, names, number, label)
        drop_tables(spark, old)
        old, number = new[-2:], number + 1
        drop_tables(spark, new[:-2])
    return names


def contract(left: DataFrame, names: DataFrame, number: int, label: str) -> tuple[DataFrame, DataFrame]:
    """One round: the edges between what the vertices are hooked to, and the names after it."""
    first = lambda *c: F.struct(F.xxhash64(F.lit(number), *c).alias("h"), *c)
    both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(first(F.col("b").alias("v"))).alias("m"))
    hooks = materialize(near.select("a", F.least(first(F.col("a").alias("v")), "m")["v"].alias("m")), label)
    # what a vertex is hooked to is a vertex with edges, and so is hooked too
    to = materialize(hooks.join(hooks.select(F.col("a").alias("m"), F.col("m").alias("to")), "m").select("a", F.col("to").alias("m")), label)
    by_a = left.join(to, "a").select(F.col("m").alias("x"), "b")
    renamed = by_a.join(to.withColumnRenamed("a", "b"), "b").select("x", F.col("m").alias("y")).where("x != y")
    # root -> m for roots that still have edges
    named = names.join(to, names["root"] == to["a"], "left").select("node", F.coalesce("m", "root").alias("root"))
    return (
        materialize(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), label),
        materialize(named, label),
    )
