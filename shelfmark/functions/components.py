"""Connected components of an edge table, to convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import remove_folder, shared_folder


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, label`` of every vertex with an edge; the label is the smallest id of its component.

    Each round a vertex takes the smallest label of itself and its neighbours, then the
    label of that label.  Rounds go on until none changes; each is written to the shared
    folder, so no lineage grows and a lost executor costs one round at most.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = _written(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = _written(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = _written(lower.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("label < old").isEmpty():
            return labels


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """As ``connected``, for graphs with hubs and long chains.

    Two steps alternate until the edges stay as they are.  The large star links every
    larger neighbour of a vertex to the smallest id around it, the small star every
    smaller one and the vertex itself, so that chains halve and hubs end at their
    component's smallest id; each takes the smallest id from one aggregation with
    map-side partials.  Edges meet the one row of their vertex in a join whose hot
    partitions adaptive execution splits, so a hub is not one task.
    """
    spark = edges.sparkSession
    folders: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        folders.append(shared_folder(spark, "stars"))
        df.write.parquet(folders[-1])
        for done in folders[:-1]:
            remove_folder(spark, done)
        del folders[:-1]
        return spark.read.schema(df.schema).parquet(folders[-1])

    def around(df: DataFrame) -> DataFrame:
        return df.groupBy("x").agg(F.min("y").alias("low"))

    def large(links: DataFrame) -> DataFrame:
        """``links`` lead from the larger to the smaller id, and so does the result."""
        up = links.select(F.col("y").alias("x"), F.col("x").alias("y"))
        near = up.join(around(links.unionByName(up)), "x")
        return near.select(F.col("y").alias("x"), F.least("x", "low").alias("y")).distinct()

    def small(links: DataFrame) -> DataFrame:
        lows = around(links)
        others = links.join(lows, "x").where("y != low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        return others.unionByName(lows.select("x", F.col("low").alias("y"))).distinct()

    def seal(links: DataFrame) -> tuple:
        """Equal for equal sets of edges."""
        h = F.xxhash64("x", "y")
        return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())

    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    links = kept(ends.distinct())
    before = None
    while (now := seal(links)) != before:
        before = now
        links = kept(small(kept(large(links))))
    roots = links.select(F.col("y").alias("id"), F.col("y").alias("label")).distinct()
    return links.select(F.col("x").alias("id"), F.col("y").alias("label")).unionByName(roots)
