"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import materialise


def _mark(edges: DataFrame) -> tuple:
    """Order-free mark of a set of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    # both sides are plain scans behind their shuffle, so a hub's rows can be split by AQE
    return rows.join(materialise(least, "least"), "a")


def connected_components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id of ``links`` (columns ``a``, ``b``); root is the component's smallest id.

    Alternates large-star and small-star steps: every id is tied to the smallest
    of its neighbours until only stars are left, in a logarithmic number of rounds.
    Minima are aggregated before the shuffle; each round is written to the shared
    folder, which also cuts the lineage. Links to itself or to null are ignored.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while (mark := _mark(edges)) != seen and mark[0]:
        seen = mark
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _joined(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _joined(large.where("a <> b"), least)
        edges = materialise(
            small.select(F.explode(F.array(
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            )).alias("e")).select("e.*").where("a <> b").distinct(),
            "links",
        )
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
