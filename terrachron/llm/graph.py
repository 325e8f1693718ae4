"""Connected components of a graph whose nodes are longs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrachron.session import work_path

#: Nodes of which every task is sent the smallest neighbour; bounds memory, not results.
BROADCAST_NODES = 250_000


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(df: DataFrame, path: str) -> None:
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached, for nodes with an edge.

    Alternates two steps until every edge leads from a node to the smallest of its component:
    every node links its larger neighbours to its smallest one, then its smaller ones. Edges never
    become more, and every round is written to the shared folder. A node's smallest neighbour
    is sent to all tasks while nodes are few, so edges stay where they are and a node with very many of them
    is not gathered; beyond, joins shuffle. Loops and rows with a null are ignored.
    """
    first, second = edges[a].cast("long"), edges[b].cast("long")
    pairs = edges.where(first != second).select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).distinct()
    pairs, path = write(pairs, "edges")
    while True:
        ends = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        nodes = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        nodes = nodes.select("u", F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("tangled"))
        nodes, nodes_path = write(nodes, "nodes")
        state = nodes.agg(F.count("*").alias("nodes"), F.count_if("tangled").alias("tangled")).first()
        if not state["tangled"]:  # who has a smaller neighbour has no other, which then is the component's smallest
            remove(pairs, path)
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("component"))
        sent = F.broadcast if state["nodes"] <= BROADCAST_NODES else lambda df: df
        large = ends.where("v > u").join(sent(nodes.select("u", "m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        following = large.join(sent(least), "u").select(small.alias("x")).select("x.*").where("u <> v").distinct()
        following, fresh = write(following, "edges")
        remove(pairs, path)
        remove(nodes, nodes_path)
        pairs, path = following, fresh
