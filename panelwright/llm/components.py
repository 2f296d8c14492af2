"""Connected components of an edge table, without moving edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.scratch import pin


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return (
        both.where("b > a").join(least, "a").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge that is not its component's smallest id.

    ``edges`` has two long columns ``a`` and ``b``. Large-star and small-star steps alternate until
    the edges stop changing: each is a join with the smallest neighbour, so a vertex with very many
    neighbours is aggregated before it is shuffled and its join may be split. Every round is written
    to the scratch folder, which keeps the lineage short. Loops and repeated edges do no harm; rows
    with a null end are ignored; without edges the result is empty.
    """
    state = pin(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct(), "edges"
    )

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(state)
    while seen[0]:
        state = pin(_small_star(_large_star(state).distinct()).distinct(), "edges")
        now = mark(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("id"), F.col("b").alias("component"))
