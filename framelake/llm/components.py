"""Connected components by repeated contraction; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``links`` (a long, b long).

    Each round every node takes the least node among itself and its neighbours, and links are renamed by that.
    Least means by id in even rounds, which folds a star at once, and by a hash in odd ones, which halves a path
    in expectation; rounds are thus logarithmic. Links between equal ids are ignored; an empty table gives none.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.table(links, f"{name}-0")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        k = len(maps)
        both = links.select(F.col("a").alias("id"), F.col("b").alias("x")).union(links.select("b", "a"))
        if k % 2:
            rank = F.struct(F.xxhash64("x", F.lit(k)), "x")
            own = F.struct(F.xxhash64("id", F.lit(k)), F.col("id").alias("x"))
            to = both.groupBy("id").agg(F.min(rank).alias("m")).select("id", F.least("m", own)["x"].alias("to"))
        else:
            to = both.groupBy("id").agg(F.min("x").alias("m")).select("id", F.least("m", "id").alias("to"))
        to = scratch.table(to, f"{name}-to-{k}")
        maps.append(to)
        renamed = links.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(
            to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b"
        )
        renamed = renamed.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        links = scratch.table(renamed, f"{name}-{k + 1}")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].select("id", F.col("to").alias("root"))
    for to in maps[1:]:
        out = out.join(to.select(F.col("id").alias("root"), F.col("to").alias("next")), "root", "left")
        out = out.select("id", F.coalesce("next", "root").alias("root"))
    out = scratch.table(out, f"{name}-root")
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return scratch.table(out.join(least, "root").select("id", "component"), f"{name}-labels")
