"""Cutting lineage, and connected components, on frames that grow with the data."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import shared_folder, stored_aside

LOCAL_EDGES = 20_000  # up to so many directed edges, components are found on the driver


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there.

    A checkpoint keeps the size that Spark estimates for its plan, a product over
    the joins.  Made from checkpoints in turn, its digits multiply every round,
    until the driver has no memory for the number; the frame is given out without.
    """
    kept = stored_aside(df)
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), df.sparkSession)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to a folder of its own below the shared
    checkpoint folder, and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_join(rows: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Rows joined with sums by a whole-number key.  The complement of the key
    gives the sums an exchange of their own; without it their side of the join
    cannot be dealt again and adaptive execution could not split a hot key."""
    name = f"not_{key}"
    left, right = rows.withColumn(name, F.bitwise_not(key)).drop(key), sums.withColumn(name, F.bitwise_not(key)).drop(key)
    return left.join(right, name).withColumn(key, F.bitwise_not(name)).drop(name)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each end of an edge ``a``-``b`` can reach.

    Every round hooks the parents of both ends of an edge to the smaller
    grandparent and shortens all paths, so the rounds grow with the logarithm of
    the longest chain.  Each step is a join or a minimum with partial sums; a
    vertex with very many edges is never collected.  Up to ``LOCAL_EDGES`` edges
    are joined on the driver, with the same result.
    """
    edges = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    few = edges.limit(LOCAL_EDGES + 1).toArrow()
    if few.num_rows <= LOCAL_EDGES:
        return edges.sparkSession.createDataFrame(_components_of(few))
    parent = edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("up"))
    parent = checkpointed(parent)
    while True:
        grand = parent.join(parent.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", "up", "top")
        seen = (
            edges.join(grand.select(F.col("id").alias("a"), F.col("up").alias("own")), "a")
            .join(parent.select(F.col("id").alias("b"), F.col("up").alias("other")), "b")
        )
        hooks = seen.select(F.explode(F.array("a", "own")).alias("id"), "other").groupBy("id").agg(F.min("other").alias("low"))
        after = checkpointed(
            grand.join(hooks, "id", "left").select("id", F.least("top", "low").alias("up"), (F.least("top", "low") < F.col("up")).alias("moved"))
        )
        parent = after.select("id", "up")
        if after.where("moved").isEmpty():
            return parent.select("id", F.col("up").alias("component"))


def _components_of(edges: pa.Table) -> pa.Table:
    up: dict[int, int] = {}

    def root(vertex: int) -> int:
        while up.setdefault(vertex, vertex) != vertex:
            up[vertex] = up[up[vertex]]
            vertex = up[vertex]
        return vertex

    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True):
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return pa.table({"id": pa.array(list(up), pa.int64()), "component": pa.array([root(vertex) for vertex in list(up)], pa.int64())})


def smallest_marks(rows: DataFrame, kind: str, mark: str, n: int, salts: int = 16) -> DataFrame:
    """(kind, mark, rank) of the ``n`` smallest distinct marks of every kind.
    Each kind is first ranked in ``salts`` parts, so no task gets all of it."""
    distinct = rows.select(F.col(kind).alias("kind"), F.col(mark).alias("mark")).distinct()
    part = Window.partitionBy("kind", F.pmod("mark", F.lit(salts))).orderBy("mark")
    parted = distinct.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("rank")
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("mark"))).where(F.col("rank") <= n)
