"""Fixpoint computations over edge tables; every round is written to the shared folder."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusweave.plans.keyed import lookup, missing_from
from corpusweave.session import cut


#: Edges of a block, which a task holds as one Arrow table and a dictionary: some 100 MB with long names.
BLOCK = 1 << 18


def reach(seeds: DataFrame, edges: DataFrame, key: str, ignore: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """All nodes reachable from ``seeds[key]`` over ``edges[src, dst]``; cycles end because seen nodes are not revisited.

    Columns: key, round (0 for seeds, else the round that found it). ``ignore[key]`` nodes are neither returned nor followed; edges without a source
    or target are none.

    Edges lie in blocks by ranges of (src, dst), each of about ``block`` different edges, so a source with very many edges lies in several. A round
    walks each block that it enters to its own end, and only nodes with edges in other blocks go on to the next one: there are as many rounds as a path
    changes blocks, not as it has edges. A graph that fits one block takes one round.
    """
    seeds = seeds.select(key).distinct()
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if ignore is not None:
        ignored = ignore.select(key).distinct()
        seeds = missing_from(seeds, ignored, [key])
        edges = missing_from(edges, ignored.select(F.col(key).alias("dst")), ["dst"])
    edges = cut(edges)
    blocks = -(-edges.count() // block) or 1
    ranged = edges.repartitionByRange(blocks, "src", "dst").withColumn("block", F.spark_partition_id())
    # shuffled by block once; every round then brings its frontier to where the edges lie
    edges = cut(ranged.repartition("block"))
    places = cut(edges.select(F.col("src").alias(key), F.col("block").alias("block")).distinct())

    def walk(graph: pa.Table, heads: pa.Table) -> pa.Table:
        targets = defaultdict(list)
        for src, dst in zip(graph["src"].to_pylist(), graph["dst"].to_pylist(), strict=True):
            targets[src].append(dst)
        ahead = heads[key].to_pylist()
        walked = set(ahead)
        while ahead:
            for dst in targets.get(ahead.pop(), ()):
                if dst not in walked:
                    walked.add(dst)
                    ahead.append(dst)
        number = heads["block"][0].as_py() if heads.num_rows else 0
        found = pa.array(list(walked), heads.schema.field(key).type)
        return pa.table({key: found, "block": pa.array([number] * len(found), pa.int32())})

    seen = cut(seeds.withColumn("round", F.lit(0)))
    frontier = cut(lookup(places, seen.select(key), [key], "left_semi"))
    shape = StructType([StructField(key, edges.schema["src"].dataType), StructField("block", IntegerType())])
    step = 0
    while not frontier.isEmpty():
        step += 1
        entered = edges.join(F.broadcast(frontier.select("block").distinct()), "block", "left_semi")  # one row a block
        walked = cut(entered.groupBy("block").cogroup(frontier.groupBy("block")).applyInArrow(walk, shape))
        fresh = cut(walked.select(key).distinct().join(seen, key, "left_anti").withColumn("round", F.lit(step)))
        seen = seen.unionByName(fresh)
        elsewhere = lookup(places, fresh.select(key), [key], "left_semi")
        frontier = cut(elsewhere.join(walked, [key, "block"], "left_anti"))
    return seen


def first_positions(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth-first placement: for each root, the smallest position path by which a node is met.

    ``roots[root]``; ``edges[src, pos, dst]`` with ``pos`` the place of the edge inside its source.
    Returns root, node, place (array of positions, empty for the root itself). Only the smallest path per
    node is kept in each round, so paths are never enumerated, and a cycle only yields longer paths.
    """
    edges = cut(edges.select("src", "pos", "dst").repartition("src"))
    placed = cut(roots.select("root", F.col("root").alias("node"), F.array().cast("array<bigint>").alias("place")))
    frontier = placed
    while not frontier.isEmpty():
        met = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(
            "root", F.col("dst").alias("node"), F.concat("place", F.array(F.col("pos").cast("long"))).alias("place"),
        )
        met = met.groupBy("root", "node").agg(F.min("place").alias("place"))
        known = placed.select("root", "node", F.col("place").alias("old"))
        better = met.join(known, ["root", "node"], "left").filter("old IS NULL OR place < old").drop("old")
        frontier = cut(better)
        placed = cut(
            placed.unionByName(frontier).groupBy("root", "node").agg(F.min("place").alias("place"))
        )
    return placed
