"""Node embedding by biased random walks and Word2Vec.

Walks are of second order: returning to the node before has weight ``1 / p``, going to one of its
neighbours 1, and further away ``1 / q``, each times the edge's own weight. A step proposes an edge of
the node evenly and accepts it with its weight against the largest possible one, so it needs one edge
by its number and one look whether two nodes are linked, however many edges a hub has. All choices
are hashes of walk, step and attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import checkpoint
from tessella.operators.ranking import positions

#: Proposals that a step makes at a time; where none is accepted it goes on with further ones.
TRIES = 4


def _even(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 (exclusive) that a hash of the parts fixes."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed links ``(src, dst, w, at)``, numbered through in order of their source, and per node ``first``, ``n`` and ``top`` weight."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    each = edges.select("lo", "hi", weight.alias("w")).where("w > 0 and lo is not null and hi is not null and lo <> hi")
    both = each.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "w").unionByName(each.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "w"))
    links = both.groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn("link", F.struct("src", "dst"))
    links = checkpoint(positions(links, "link").drop("link"))
    nodes = checkpoint(links.groupBy("src").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("w").alias("top")))
    return links, nodes


def walks(edges: DataFrame, per_node: int = 10, length: int = 20, p: float = 1.0, q: float = 1.0, seed: int = 7) -> DataFrame:
    """``walk, path``: ``per_node`` walks from every node of ``edges(lo, hi, weight)``, each of ``length`` nodes.

    Links go both ways, repeated edges add up; loops and weights of zero or less are left out, a
    missing weight is one. ``walk`` is the first node with a number. The same seed gives the same
    walks, however rows are dealt. An empty table gives no walk.
    """
    links, nodes = _numbered(edges)
    known = links.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("linked"))
    begun = nodes.select(F.col("src").alias("cur"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k"))
    state = checkpoint(begun.select(F.concat_ws("#", "cur", "k").alias("walk"), F.lit(None).cast("string").alias("prev"), "cur", F.array("cur").alias("path")))
    most = max(1 / p, 1.0, 1 / q)
    for step in range(1, length):
        left, attempt, taken = state.select("walk", "prev", "cur"), 0, None
        while True:
            tries = F.explode(F.sequence(F.lit(attempt), F.lit(attempt + TRIES - 1))).alias("a")
            asked = left.join(nodes.withColumnRenamed("src", "cur"), "cur").select("walk", "prev", "cur", "first", "n", "top", tries)
            pick = F.least(F.floor(_even(seed, F.lit(step), F.col("a"), F.col("walk")) * F.col("n")), F.col("n") - 1)
            met = asked.withColumn("at", F.col("first") + pick).join(links.select("at", F.col("dst").alias("next"), "w"), "at").join(known, ["prev", "next"], "left")
            bias = F.when(F.col("prev").isNull(), most).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("linked"), 1.0).otherwise(1 / q)
            good = _even(seed + 1, F.lit(step), F.col("a"), F.col("walk")) < F.col("w") / F.col("top") * bias / most
            found = checkpoint(met.where(good).groupBy("walk").agg(F.min_by("next", "a").alias("next")))
            taken = found if taken is None else taken.unionByName(found)
            left = checkpoint(left.join(found, "walk", "left_anti"))
            attempt += TRIES
            if left.isEmpty():
                break
        state = checkpoint(state.join(taken, "walk").select("walk", F.col("cur").alias("prev"), F.col("next").alias("cur"), F.concat("path", F.array("next")).alias("path")))
    return state.select("walk", "path")


def node_vectors(edges: DataFrame, size: int = 64, window: int = 5, seed: int = 7, **parameters) -> DataFrame:
    """``id, vector`` of every node with a link, by Word2Vec over its :func:`walks` (``parameters`` are theirs)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = checkpoint(walks(edges, seed=seed, **parameters))
    if paths.isEmpty():
        return paths.select(F.lit("").alias("id"), F.array().cast("array<double>").alias("vector"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=5, seed=seed, inputCol="path", outputCol="out").fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))
