"""Connected components of a link table by alternating stars, wholly in DataFrames.

Links are kept as (u, v) with u > v. A round points each node's larger neighbours at the smallest of the node and all
its neighbours (large star), then each node and its smaller neighbours at the smallest of those (small star). The rounds
needed grow with the logarithm of the largest component. Neighbours are only ever reduced to their minimum, so no group
is gathered in one task, and the links of a node with very many are joined in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

MAX_ROUNDS = 60


def _settled(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of links (u, v); self-links and repeats are harmless.

    Null ends are left out. No links give no rows. The rounds' tables go when the last one is there.
    """
    with S.scratch(links.sparkSession) as tables:
        now = S.written(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = _settled(now)
        for _ in range(MAX_ROUNDS):
            if not mark[0]:
                break
            ends = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
            large = S.written(S.joined(now, least, "v").where("u <> m").select("u", F.col("m").alias("v")).distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            now = S.written(small.distinct())
            before, mark = mark, _settled(now)
            if mark == before:
                break
        else:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
        tables.keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
