"""Connected components of a table of links, by contraction.

In every round each node points to its smallest neighbour if that is smaller than itself, pointers are followed, and
the links are rewritten between what the nodes point to.  Links shrink by a factor in each round, whatever the shape of
the graph; a star is gone after two.  All steps are joins and groupings with partial aggregation, and every round is a
written table, so neither links nor labels reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut
from tabloom.operators.ranking import lookup

JUMPS = 2


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of a link can reach.

    Links are undirected, may be repeated and may join a node with itself; links with a null end are left out.  An
    empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    pairs = cut(_ordered(ends), "links")
    labels = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().withColumn("root", F.col("node"))
    self_linked = ends.where(F.col("u") == F.col("v")).select(F.col("u").alias("node")).distinct()
    while not pairs.isEmpty():
        up = pairs.groupBy(F.col("v").alias("_from")).agg(F.min("u").alias("_to"))
        for _ in range(JUMPS):
            up = _follow(up, up, "_to")
        up = cut(up, "pointers")
        labels = _follow(labels, up, "root")
        pairs = cut(_ordered(_follow(_follow(pairs, up, "u"), up, "v")), "links")
    labels = cut(labels, "labels")
    return labels.unionByName(self_linked.join(labels, "node", "left_anti").withColumn("root", F.col("node")))


def of_root(nodes: DataFrame, values: DataFrame, take: list[str]) -> DataFrame:
    """``nodes`` with columns of ``values``, which has one row per root with its number ``n`` of nodes.  A root with very many
    nodes is looked up in a broadcast, so no task receives all of them."""
    values = cut(values, "roots")
    return lookup(nodes, values, ["root"], take, values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], None)


def _ordered(pairs: DataFrame) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    return (
        pairs.where(u != v).select(F.when(u < v, u).otherwise(v).alias("u"), F.when(u < v, v).otherwise(u).alias("v"))
        .distinct()
    )


def _follow(rows: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """Replaces a column by what it points to.

    Many rows may point to one node, as all members of a star do after a round.  Nodes with a thousandth of the rows or
    more are looked up in a broadcast of at most a thousand of them, so no task receives what points to one node.
    """
    counts = rows.groupBy(F.col(column).alias("_from")).agg(F.count(F.lit(1)).alias("n"))
    table = cut(up.withColumnRenamed("_to", "_next").join(counts, "_from").withColumnRenamed("_from", column), "followed")
    total = table.agg(F.sum("n")).first()[0]
    if not total:
        return rows
    found = lookup(rows, table, [column], ["_next"], total, None)
    return found.withColumn(column, F.coalesce("_next", column)).select(*rows.columns)
