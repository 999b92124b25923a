"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldloom.plans.tables import remove, save

#: Edges up to which the smallest neighbours are sent to all tasks, at 16 bytes a node.
SENT_EDGES = 500_000


def counted(edges: DataFrame) -> tuple[DataFrame, int, object]:
    """The edges ``u, v`` as a written table, their number, and a sum of their hashes, all from one job."""
    seen = Observation()
    rows = save(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")), "components")
    return rows, seen.get["n"], seen.get["mark"]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node with an edge; a component is its smallest node.

    Alternates two steps until nothing changes: each node's larger neighbours are tied to the
    smallest of its neighbourhood, then its smaller ones are. Both keep components and shorten
    paths, so the rounds grow with the logarithm of the graph's size. Every half round is
    written to the shared folder. The smallest neighbours are aggregated before the shuffle; of small
    graphs they are sent to all tasks, else they are joined as a written table, so that a hub's rows
    can be split.
    """
    now, n, mark = counted(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        few, spent = n <= SENT_EDGES, [now]

        def sent(rows: DataFrame, few: bool = few, spent: list = spent) -> DataFrame:
            if few:
                return F.broadcast(rows)
            spent.append(save(rows, "components-lowest"))
            return spent[-1]

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = sent(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = save(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        spent.append(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest if few else sent(lowest)
        tied = large.join(F.broadcast(lowest) if few else lowest, "u")
        small, n, new_mark = counted(tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        for old in spent:
            remove(old)
        now = small
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
