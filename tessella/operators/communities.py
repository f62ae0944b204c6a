"""Communities by modularity: Louvain's method as joins and aggregations.

A level moves nodes between communities in rounds. In each round every node's gain in every
neighbouring community is found by one aggregation of its links. All nodes at once would swap for ever,
so those move whose gains, less what the others' moves can take from them, add up: every round gains.
A level ends when no node gains any more; then communities become nodes, with the links between them
summed, and the next begins. The last is the one in which no community gains. Neither has a set number.
Once communities have few links between them, one task takes these through all further levels, community
after community: rounds over a small graph are many, and cost the fixed time of their jobs.

Links are dealt out once a level, into a table with a bucket for each part of the nodes where they begin.
A round sends a node's community once to each part with a neighbour, not once to each neighbour; links stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.graph import checkpoint

#: A level ends when all the gains that its nodes could make come to less modularity than this, that of a pass in python-louvain.
LEAST = 1e-7
#: Links of a part: at most the first on average; at least the second where there are no more parts than cores.
MOST_LINKS, FEW_LINKS = 3_000_000, 100_000
#: Tables of at most so many rows go whole to every task.
FEW_ROWS = 100_000
#: Communities with at most so many links between them, each counted from both ends, are settled by one task, which holds some 16 bytes of each and a few copies while it sorts.
LAST_LINKS = 2_000_000
#: Where this is true, a join on part and node would deal out again what is dealt by part already.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _dealt_by_part(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


class _Parts:
    """Parts of the nodes, each with a bucket and a partition of its own, and the tables dealt out so."""

    def __init__(self, spark: SparkSession, links: int):
        self.spark, self.tables = spark, []
        self.count = max(-(-links // MOST_LINKS), min(-(-links // FEW_LINKS), spark.sparkContext.defaultParallelism), 2)  # Spark deals again what lies in one partition
        # numbers that Spark's hash deals to partitions 0, 1, ...
        found, tried = {}, 16 * self.count
        while len(found) < self.count:
            tried *= 2
            each = spark.range(tried).select(F.col("id").cast("int").alias("n"))
            found = dict(each.groupBy(F.pmod(F.hash("n"), F.lit(self.count))).agg(F.min("n")).collect())
        self.numbers = F.array(*[F.lit(found[p]).cast("int") for p in range(self.count)])

    def of(self, node: str) -> Column:
        return F.get(self.numbers, F.pmod(F.xxhash64(node), F.lit(self.count)).cast("int")).alias("part")

    def dealt(self, frame: DataFrame) -> DataFrame:
        return frame.repartition(self.count, "part")

    def table(self, links: DataFrame) -> DataFrame:
        """``links(src, dst, w)`` with their weights summed, in a table with a bucket for each part of ``src``."""
        self.tables.append(f"louvain_{uuid.uuid4().hex}")
        each = self.dealt(links.select(self.of("src"), "src", "dst", "w")).groupBy("part", "src", "dst").agg(F.sum("w").alias("w"))
        each.write.bucketBy(self.count, "part").sortBy("src").option("compression", "zstd").saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def drop(self, kept: int = 0) -> None:
        """Drop all tables but the last ``kept``."""
        while len(self.tables) > kept:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(0)}")


@dataclass
class _Level:
    """Links in both directions ``(part, src, dst, w)``, loops ``(id, w)``, nodes ``(id, k, parts)`` with the parts where they have neighbours, and the sum of all ``k``."""

    links: DataFrame
    loops: DataFrame
    nodes: DataFrame
    total: float
    parts: _Parts


def _level(links: DataFrame, loops: DataFrame, parts: _Parts) -> _Level:
    loops = checkpoint(loops)
    ends = links.groupBy("part", "src").agg(F.sum("w").alias("w")).select(F.col("src").alias("id"), "w").unionByName(loops.select("id", (F.col("w") * 2).alias("w")))
    near = links.select("part", F.col("dst").alias("id")).distinct().repartition("id").groupBy("id").agg(F.collect_list("part").alias("parts"))
    nodes = checkpoint(ends.groupBy("id").agg(F.sum("w").alias("k")).join(near, "id", "left"))
    return _Level(links, loops, nodes, nodes.agg(F.sum("k")).first()[0] or 0.0, parts)


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= FEW_ROWS else frame


def _near(level: _Level, placed: DataFrame, totals: DataFrame) -> DataFrame:
    """``part, id, c, tot, w`` for each community ``c`` of ``totals(c, tot)`` near a node, and ``was, k, own_tot`` of the node, all without moving links."""
    whole = placed.join(totals, "c")
    told = whole.select(F.explode("parts").alias("part"), F.col("id").alias("dst"), "c", "tot")
    near = level.links.join(level.parts.dealt(told).hint("shuffle_hash"), ["part", "dst"]).groupBy("part", F.col("src").alias("id"), "c")
    # with a struct to keep, Spark sums in the order of the keys, which the choice of the best then needs as well: one sort and no hash table of all
    near = near.agg(F.sum("w").alias("w"), F.first(F.struct("tot")).alias("of")).select("part", "id", "c", "w", "of.tot")
    own = whole.where("parts is not null").select(level.parts.of("id"), "id", F.col("c").alias("was"), "k", F.col("tot").alias("own_tot"))
    return near.join(level.parts.dealt(own).hint("shuffle_hash"), ["part", "id"])


def _wanted(level: _Level, near: DataFrame) -> DataFrame:
    """Nodes that would gain by a move, ``(id, c, to, k, gain)``, with the community in which they gain most, by ``near(part, id, c, w, tot, was, k, own_tot)``."""
    stays = F.col("c") == F.col("was")
    worth = lambda w, tot: F.round(w - F.col("k") * tot / level.total, 9)
    each = near.withColumn("worth", worth(F.col("w"), F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)))
    # of equal worth the smallest community; a node whose own is as good stays
    best = each.groupBy("part", "id").agg(
        F.min(F.struct((-F.col("worth")).alias("loss"), "c")).alias("best"), F.sum(F.when(stays, F.col("w")).otherwise(0.0)).alias("w"), *[F.first(c).alias(c) for c in ("was", "k", "own_tot")]
    )
    gain = -F.col("best.loss") - worth(F.col("w"), F.col("own_tot") - F.col("k"))
    return best.select("id", F.col("was").alias("c"), F.col("best.c").alias("to"), "k", gain.alias("gain")).where("gain > 0")


def _moves(level: _Level, wanted: DataFrame, rows: int, salt: int) -> DataFrame:
    """Those of ``wanted`` that add modularity together, at least the first of them.

    A community is either left or joined in a round, as the first move has it that touches it. Then links between
    nodes that move only add; what nodes before a node bring to its new community, or take from its old one, costs it ``k``
    times their ``k`` by the total. Nodes move whose gain is more than that, so the sum of gains less costs is the least that is added.
    First are the larger gains, of gains within a factor of two any: in strict order a chain of nodes would move one by one.
    """
    rank = F.struct(-F.floor(F.log2("gain")), F.xxhash64("id", F.lit(salt)), "id")
    wanted = wanted.withColumn("rank", rank)
    sides = F.array(*[F.struct(F.col(x).alias("of"), F.lit(x == "c").alias("left")) for x in ("c", "to")])
    roles = wanted.select(F.explode(sides).alias("x"), "rank").groupBy("x.of").agg(F.min(F.struct("rank", "x.left")).alias("first")).select("of", "first.left")
    for side, left in (("c", True), ("to", False)):
        wanted = wanted.join(_small(roles.where(F.col("left") == left).select(F.col("of").alias(side)), 2 * rows), side, "left_semi")
    for side in ("to", "c"):
        before = Window.partitionBy(side).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        cost = F.col("k") * F.coalesce(F.sum("k").over(before), F.lit(0.0)) / level.total
        wanted = wanted.withColumn("gain", F.col("gain") - cost).where("gain > 0")
    return wanted.select("id", "to")


def _settled(level: _Level, rounds: int | None, last: bool) -> tuple[DataFrame, bool, DataFrame | None]:
    """The communities ``placed(id, c, k)`` of a level, whether any node moved, and unless ``last`` the table of their links."""
    placed, done, between = level.nodes.select("id", F.col("id").alias("c"), "k", "parts"), 0, None
    while True:
        totals = placed.groupBy("c").agg(F.sum("k").alias("tot")).persist()
        near = _near(level, placed, _small(totals, totals.count()))
        wanted = _wanted(level, near).persist()
        try:
            rows, gains = wanted.agg(F.count("*"), F.sum("gain")).first()
            if done == rounds or 2 * (gains or 0.0) / level.total < LEAST:
                if done and not last:
                    between = level.parts.table(near.groupBy("part", "was", "c").agg(F.sum("w").alias("w")).select(F.col("was").alias("src"), F.col("c").alias("dst"), "w"))
                return placed, done > 0, between
            moves = _moves(level, wanted, rows, done)
            placed = checkpoint(placed.join(_small(moves, rows), "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", "parts"))
            done += 1
        finally:
            wanted.unpersist()
            totals.unpersist()


def _last_levels(levels: int | None) -> Callable[[Iterator], Iterator]:
    """A task of ``id, c`` of the nodes of ``batches(src, dst, w)``, which have each link once and loops, after all levels or ``levels`` of them."""

    def moved_in_turn(start, near, w, k, total):
        """Communities of nodes 0, 1, ..., moved in turn until none gains; ``near`` and ``w`` have the links of node ``i`` from ``start[i]`` on."""
        of, tot, moved_any, moved, least = list(range(len(k))), list(k), False, True, 1e-13 * total
        while moved:
            moved = False
            for i, ki in enumerate(k):
                own, sums, share = of[i], {of[i]: 0.0}, ki / total
                for j, x in zip(near[start[i] : start[i + 1]].tolist(), w[start[i] : start[i + 1]].tolist(), strict=True):
                    c = of[j]
                    sums[c] = sums.get(c, 0.0) + x
                tot[own] -= ki
                best, most = own, sums[own] - share * tot[own] + least
                for c, x in sums.items():
                    worth = x - share * tot[c]
                    if worth > most:
                        best, most = c, worth
                tot[best] += ki
                if best != own:
                    of[i], moved, moved_any = best, True, True
        return of, moved_any

    def run(batches):
        import numpy as np
        import pyarrow as pa

        each = pa.Table.from_batches(list(batches))
        named = pa.chunked_array(each["src"].chunks + each["dst"].chunks).combine_chunks().dictionary_encode()
        names = np.array(named.dictionary.to_pylist(), dtype=object)
        order = np.argsort(names)  # numbered by name, so that the order of rows does not count
        ids, ends = names[order], np.argsort(order)[named.indices.to_numpy()]
        (src, dst), w, of, number = ends.reshape(2, -1), each["w"].to_numpy(), np.arange(len(ids)), 0
        del each, named
        while levels is None or number < levels:
            low, high, n = np.minimum(src, dst), np.maximum(src, dst), of.max() + 1
            order = np.lexsort((w, high, low))
            low, high, w = low[order], high[order], w[order]
            first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            src, dst, w = low[first], high[first], np.add.reduceat(w, first)
            k, apart = np.bincount(src, w, n) + np.bincount(dst, w, n), src != dst
            begin, end, both = np.r_[src[apart], dst[apart]], np.r_[dst[apart], src[apart]], np.r_[w[apart], w[apart]]
            order = np.lexsort((end, begin))
            start = np.searchsorted(begin[order], np.arange(n + 1))
            to, moved = moved_in_turn(start.tolist(), end[order], both[order], k.tolist(), float(k.sum()))
            if not moved:
                break
            number += 1
            to = np.unique(to, return_inverse=True)[1]
            of, src, dst = to[of], to[src], to[dst]
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "c": pa.array(ids[np.unique(of, return_index=True)[1]][of], pa.string())})

    return run


def louvain(edges: DataFrame, rounds: int | None = None, levels: int | None = None) -> DataFrame:
    """``id, community`` for every node of ``edges(lo, hi, weight)``; a community is named by its smallest id.

    It ends when neither nodes of a level nor whole communities gain by a move; who wants less names the most
    ``rounds`` of a level or ``levels``.

    Edges count by weight (one where there is no such column or no value), edges of equal ends and
    weights of zero or less apart: the latter are left out, loops count twice as they do in degrees.
    Repeated edges add up. Results depend on the graph only, not on how rows are dealt. An empty
    table gives no row. Tables of links lie in the warehouse until the end.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    each = edges.select("lo", "hi", weight.alias("w")).where("w > 0 and lo is not null and hi is not null").persist()
    try:
        parts = _Parts(edges.sparkSession, 2 * each.count())
        with _dealt_by_part(edges.sparkSession):
            return _communities(each, parts, rounds, levels)
    finally:
        each.unpersist()


def _communities(each: DataFrame, parts: _Parts, rounds: int | None, levels: int | None) -> DataFrame:
    try:
        ways = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("lo", "hi"), ("hi", "lo"))])
        links = parts.table(each.where("lo <> hi").select(F.explode(ways).alias("x"), "w").select("x.src", "x.dst", "w"))
        level = _level(links, each.where("lo = hi").groupBy(F.col("lo").alias("id")).agg(F.sum("w").alias("w")), parts)
        found, number = level.nodes.select("id", F.col("id").alias("c")), 0
        while level.total and (levels is None or number < levels):
            placed, moved, between = _settled(level, rounds, number + 1 == levels)
            if not moved:
                break
            number += 1
            step = placed.select(F.col("id").alias("c"), F.col("c").alias("to"))
            found = checkpoint(found.join(step, "c").select("id", F.col("to").alias("c")))
            if number == levels:
                break
            kept = level.loops.join(placed, "id").select(F.col("c").alias("id"), "w")
            inner = between.where("src = dst").select(F.col("src").alias("id"), (F.col("w") / 2).alias("w"))
            loops = kept.unionByName(inner).groupBy("id").agg(F.sum("w").alias("w"))
            if rounds is None and between.count() <= LAST_LINKS:
                left = None if levels is None else levels - number
                rest = between.where("src < dst").select("src", "dst", "w").unionByName(loops.select(F.col("id").alias("src"), F.col("id").alias("dst"), "w"))
                step = rest.repartition(1).mapInArrow(_last_levels(left), "id string, c string")
                found = checkpoint(found.join(step.select(F.col("id").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")))
                break
            level = _level(between.where("src <> dst"), loops, parts)
            parts.drop(kept=1)
        names = found.groupBy("c").agg(F.min("id").alias("community"))
        return checkpoint(found.join(names, "c").select("id", "community"))
    finally:
        parts.drop()


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity of ``communities(id, community)`` on ``edges(lo, hi, weight)``."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    each = edges.select("lo", "hi", weight.alias("w")).where("w > 0 and lo is not null and hi is not null")
    where = communities.select("id", "community")
    placed = checkpoint(each.join(where.toDF("lo", "a"), "lo").join(where.toDF("hi", "b"), "hi").select("a", "b", "w"))
    total, inside = placed.agg(F.sum(F.col("w") * 2), F.sum(F.when(F.col("a") == F.col("b"), F.col("w") * 2))).first()
    if not total:
        return 0.0
    ends = placed.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    return (inside or 0.0) / total - ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / total**2
