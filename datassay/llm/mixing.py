"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed by source, and targets set by weight with a cap (see targets()).
2. A source's documents are dealt into at most blocks_per_source blocks by a hash of their id: the
   order of the blocks is a permutation of the source. The target is so many whole passes over the
   source plus a part of one: whole blocks, then documents of one last block, in pieces by more of the hash.
3. The drawn blocks are an exact quota per source. The tree splits the quotas between the two halves of
   the output shards by a multivariate hypergeometric draw, and again in each half, down to one shard;
   each shard then has exact counts per source, as if the whole had been shuffled and cut.
4. Shards take disjoint runs of each source's permuted blocks. Within a shard documents are ordered
   by a hash of shard, document and pass.

Only sums of sources and blocks reach the driver: at most sources * blocks_per_source of them,
whatever the number of documents. Draws are seeded, so reruns agree.

Edge cases: a null text has size 0; a null source is a source, ordered last; documents of size 0 count in
no target and are taken with their block; an empty table gives an empty result; repeated rows are
documents of their own; columns not named pass through or are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

#: Assignments of up to so many blocks are broadcast.
BROADCAST_BLOCKS = 1_000_000
#: Pieces of the one block of a source that is drawn in part.
PIECES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict:
    """Source -> target: all sizes shared by weight (sources by code point, null last), none above most times its size; what is above is reshared by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact quotas of every shard, by hypergeometric draws down a binary tree of shards."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, counts = todo.pop()
        if high - low == 1:
            out[low] = counts
            continue
        middle = (low + high) // 2
        take = int(counts.sum() * (middle - low) // (high - low))
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, take, method="marginals")
        todo += [(low, middle, left), (middle, high, counts - left)]
    return out


def mixing_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, shard_words: int = 500_000, blocks_per_source: int = 1024, seed: int = 11, keep: bool = False) -> DataFrame:
    """Each row of df (with keep, all its columns) with datassay_size, datassay_source_size, datassay_target and datassay_shards: the output shard of each time it is drawn."""
    columns = df.columns if keep else list(dict.fromkeys([id_col, source_col]))
    own = {c: f"datassay_{c}" for c in ("size", "block", "rank")}
    base = df.select(*[F.col(f"`{c}`") for c in columns], word_count(F.col(f"`{text_col}`")).alias(own["size"]), F.col(f"`{source_col}`").cast("string").alias("datassay_source"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias(own["rank"]))
    spread = F.pmod(F.shiftrightunsigned(F.col(own["rank"]), 20), F.lit(blocks_per_source)).cast("int")
    base = base.withColumn(own["block"], spread)
    if not keep:
        base = materialize(base, "mixing-sizes")
    spark = df.sparkSession
    sums = base.groupBy("datassay_source", own["block"]).agg(F.sum(own["size"]).alias("words")).collect()
    sizes: dict = {}
    blocks: dict = {}
    for r in sums:
        sizes[r["datassay_source"]] = sizes.get(r["datassay_source"], 0) + r["words"]
        blocks.setdefault(r["datassay_source"], {})[r[own["block"]]] = r["words"]
    target = targets(sizes, weights, most)
    drawn: list[tuple] = []  # (source, block, pass, words of the block to take, or None for all)
    quota: list[list[tuple]] = []
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    for s in order:
        passes = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = target[s] - passes * sizes[s]
        mine = [(s, b, p, None) for p in range(passes) for b in sorted(blocks[s])]
        for b in sorted(blocks[s]):
            if rest <= 0:
                break
            words = blocks[s][b]
            mine.append((s, b, passes, None if words <= rest else float(rest)))
            rest -= words
        quota.append(mine)
        drawn += mine
    shards = max(1, min(len(drawn), int(-(-sum(target.values()) // shard_words))))
    counts = split_tree(np.array([len(q) for q in quota] or [0]), shards, seed)
    rows = []
    for i, mine in enumerate(quota):
        shuffled = np.random.default_rng([seed, i]).permutation(len(mine))
        to = np.repeat(np.arange(shards), counts[:, i])
        for k, shard in zip(shuffled, to):
            s, b, p, part = mine[int(k)]
            rows.append((s, b, p, part, int(shard)))
    plan: dict[tuple, tuple[list[int], float | None, int | None]] = {}
    for s, b, p, part, shard in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        whole, words, last = plan.setdefault((s, b), ([], None, None))
        plan[s, b] = ([*whole, shard], words, last) if part is None else (whole, part, shard)
    schema = T.StructType([T.StructField("datassay_s", T.StringType()), T.StructField("datassay_b", T.IntegerType()), T.StructField("datassay_source_size", T.LongType()), T.StructField("datassay_target", T.DoubleType()), T.StructField("datassay_whole", T.ArrayType(T.IntegerType())), T.StructField("datassay_words", T.DoubleType()), T.StructField("datassay_last", T.IntegerType())])
    given = [(s, b, sizes[s], float(target[s]), *plan.get((s, b), ([], None, None))) for s in order for b in sorted(blocks[s])]
    table = spark.createDataFrame(given, schema)
    joined = base.join(F.broadcast(table) if len(given) <= BROADCAST_BLOCKS else table, F.col("datassay_source").eqNullSafe(F.col("datassay_s")) & (F.col(own["block"]) == F.col("datassay_b")))
    # Documents of the one last block of each source, in hash order, up to the words that are left.
    some, size = F.col("datassay_words").isNotNull(), F.col(own["size"])
    result = [*[F.col(f"`{c}`") for c in columns], size, "datassay_source_size", "datassay_target"]
    rest = joined.where(~some).select(*result, F.col("datassay_whole").alias("datassay_shards"))
    # The block is cut by more of the hash, so no task sorts the whole of it: a piece's start is the sum of the pieces before it.
    last = joined.where(some).withColumn("datassay_piece", F.pmod(F.shiftrightunsigned(F.col(own["rank"]), 32), F.lit(PIECES)).cast("int"))
    sums = last.groupBy("datassay_source", "datassay_piece").agg(F.sum(size).alias("datassay_in"))
    ahead = Window.partitionBy("datassay_source").orderBy("datassay_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("datassay_source").alias("datassay_ps"), F.col("datassay_piece").alias("datassay_pp"), F.coalesce(F.sum("datassay_in").over(ahead), F.lit(0)).alias("datassay_start"))
    starts = F.broadcast(starts) if len(order) * PIECES <= BROADCAST_BLOCKS else starts
    last = last.join(starts, F.col("datassay_source").eqNullSafe(F.col("datassay_ps")) & (F.col("datassay_piece") == F.col("datassay_pp")))
    within = Window.partitionBy("datassay_source", "datassay_piece").orderBy(own["rank"], F.col(f"`{id_col}`"), size).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("datassay_before", F.col("datassay_start") + F.sum(size).over(within) - size)
    taken = F.col("datassay_before") + size / 2 <= F.col("datassay_words")
    last = last.select(*result, F.when(taken, F.concat("datassay_whole", F.array("datassay_last"))).otherwise(F.col("datassay_whole")).alias("datassay_shards"))
    return rest.unionByName(last)


def mix_sources(df: DataFrame, id_col: str = "doc_id", seed: int = 11, **more) -> DataFrame:
    """df's rows as often as they are drawn, with shard and position key; each shard is one run of sorted rows within a partition.

    Columns of df that are called shard or position give way to these.
    """
    plan = mixing_plan(df, id_col=id_col, seed=seed, keep=True, **more)
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "position")]
    out = plan.select(*columns, F.posexplode("datassay_shards").alias("datassay_pass", "shard"))
    out = out.withColumn("position", F.xxhash64(F.lit(seed), "shard", F.col(f"`{id_col}`"), "datassay_pass")).drop("datassay_pass")
    return out.repartition("shard").sortWithinPartitions("shard", "position")


def mixing_report(df: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """id_col, size, source_size, target, taken, and shards: the output shards that the tree gave the document to, comma-joined, one each time it is drawn."""
    plan = mixing_plan(df, id_col=id_col, **more)
    size, shards = F.col("datassay_size"), F.col("datassay_shards")
    return plan.select(F.col(f"`{id_col}`"), size.alias("size"), F.col("datassay_source_size").alias("source_size"), F.col("datassay_target").alias("target"), (size * F.size(shards)).cast("bigint").alias("taken"), F.array_join(shards.cast("array<string>"), ",").alias("shards"))
