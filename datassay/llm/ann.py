"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy graph search.

Index, over every row: equal vectors are one node. A node is its vector, lengthened by one component so that
all have the same length (inner products with a query stay as they are): the vector in 12-bit codes of its own
scale, whose products are exact integers; the added component follows from the length, in doubles. The graph starts from neighbours within leaves: one random grouping, and groups by the
signs of random projections, large leaves cut by hash. Each round of NN-descent is a join of neighbours of
neighbours: the neighbours of a node, both ways, meet at that node with their codes, are compared,
and those that beat a neighbour's worst go to its list. It stops when few lists change.

Search: a query's node is where it starts (other queries start from given nodes). In each round every
query expands the best unexpanded nodes of its beam: a join of (query, node) with the graph, whose rows
carry the neighbours' codes. It ends when no beam has an unexpanded node. The beam's nodes are then scored
again from the original vectors in double precision.

No list of all nodes is held anywhere: rounds are joins on node ids, a hub's incoming links are cut to a
bounded number by hash (the method samples them by design), and a class of equal vectors passes on only its
smallest ids, by a windowed limit that Spark applies before the shuffle.

Edge cases: vectors that are null, zero or hold null or non-finite components, and null ids, take no
part; vectors are searched among those of their own length; repeated rows are candidates of their own;
fewer candidates than k give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_shuffles, materialize
from .neardup import usable

LEAF = 160
ENTRIES = 32
TOP = 2047


def encode(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codes (int16) of each row's own direction, and the scales that bring them to x / longest: no row's length takes bits from another's."""
    top = np.maximum(np.abs(x).max(1), 1e-300)
    return np.rint(x / top[:, None] * TOP).astype(np.int16), top / longest / TOP


def decode(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1).astype(np.float64)


def products(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact integer products times both scales: the same to the last bit whichever side is which."""
    return (a @ b.T) * (s[:, None] * t[None])


def similarities(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Minus half the squared distances of rows lengthened to length 1: inner products less 1, without that 1 to swallow short rows."""
    # Rounding can take the longest rows' codes beyond length 1.
    m, n = np.minimum(1, (a * a).sum(1) * (s * s))[:, None], np.minimum(1, (b * b).sum(1) * (t * t))[None]
    rest = np.sqrt(np.maximum(0, 1 - m)) + np.sqrt(np.maximum(0, 1 - n))
    return products(a, s, b, t) - (m + n) / 2 - ((m - n) / np.maximum(rest, 1e-150)) ** 2 / 2


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, its rows) from batches sorted by their first column."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, itemgetter(0)):
        yield key, list(group)


def link_batch(u: list, v: list, s: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
    return pa.RecordBatch.from_arrays([cat(u, np.int64), cat(v, np.int64), cat(s, np.float64)], names=["u", "v", "ns"])


LINK = "u bigint, v bigint, ns double"


def leaf_links(nodes: DataFrame, count: int, trees: int, keep: int, dims: int, seed: int) -> DataFrame:
    """Links within leaves: tree 0 groups by hash, others by signs of random projections."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))
    planes = np.random.default_rng(seed).normal(size=(trees, max(1, bits), dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = decode(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, dims))
            for t in range(1, trees):
                code = ((x @ planes[t].T > 0) * (1 << np.arange(max(1, bits)))).sum(1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), *batch.columns], names=["tree", "leaf", "u", "code", "scale"])

    placed = nodes.select("u", "code", "scale").mapInArrow(place, "tree int, leaf bigint, u bigint, code binary, scale double")
    random = nodes.select(F.lit(0).alias("tree"), F.pmod(F.xxhash64(F.lit(seed), "u"), F.lit(max(1, count // LEAF))).alias("leaf"), "u", "code", "scale")
    placed = materialize(placed.unionByName(random), "leaves")
    sizes = placed.groupBy("tree", "leaf").agg(F.count("*").alias("size"))
    cut = placed.join(sizes, ["tree", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("u", "tree"), F.ceil(F.col("size") / (2 * LEAF)))).withColumn("g", F.xxhash64("tree", "leaf", "sub"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in streamed(batches):
            if len(rows) < 2:
                continue
            ids, x, s = np.array([r[1] for r in rows]), decode([r[2] for r in rows]), np.array([r[3] for r in rows])
            sims = similarities(x, s, x, s)
            np.fill_diagonal(sims, -np.inf)
            k = min(keep, len(rows) - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            yield link_batch([np.repeat(ids, k)], [ids[best].ravel()], [-np.take_along_axis(sims, best, 1).ravel()])

    return cut.select("g", "u", "code", "scale").repartition("g").sortWithinPartitions("g").mapInArrow(near, LINK)


def best_of(links: DataFrame, k: int) -> DataFrame:
    """(u, nb): each node's k best distinct links, as sorted (ns, v)."""
    return links.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("ns", "v"))), 1, k).alias("nb"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, gather: int, emit: int, turn: int) -> DataFrame:
    """One round: links found among the neighbours, both ways, of each node. graph: u, nb.

    A hub's incoming links are cut by hash, to others in each round, so what one round leaves out a later one compares.
    """
    edge = graph.select("u", F.explode("nb").alias("e")).select("u", F.col("e.v").alias("v"))
    into = edge.select(F.col("v").alias("c"), F.col("u").alias("m"))
    into = into.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64(F.lit(turn), "c", "m")))).where(F.col("rn") <= gather).drop("rn")
    members = edge.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(into).distinct()
    worst = graph.select(F.col("u").alias("m"), F.when(F.size("nb") >= k, F.element_at("nb", -1)["ns"]).otherwise(F.lit(float("inf"))).alias("worst"))
    about = nodes.select(F.col("u").alias("m"), "code", "scale").join(worst, "m")
    rows = members.join(about, "m").select("c", "m", "code", "scale", "worst").repartition("c").sortWithinPartitions("c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, s, size = [], [], [], 0
        for _, own in streamed(batches):
            if len(own) < 2:
                continue
            ids, x, scale, worst = np.array([r[1] for r in own]), decode([r[2] for r in own]), np.array([r[3] for r in own]), np.array([r[4] for r in own])
            ns = -similarities(x, scale, x, scale)
            np.fill_diagonal(ns, np.inf)
            ns[ns >= worst[:, None]] = np.inf
            n = min(emit, len(own) - 1)
            best = np.argpartition(ns, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(ns, best, 1)
            i, j = np.nonzero(np.isfinite(value))
            if len(i):
                u.append(ids[i])
                v.append(ids[best[i, j]])
                s.append(value[i, j])
                size += len(i)
            if size > 200_000:
                yield link_batch(u, v, s)
                u, v, s, size = [], [], [], 0
        if size:
            yield link_batch(u, v, s)

    return rows.mapInArrow(join, LINK)


def build_graph(nodes: DataFrame, count: int, dims: int, k: int = 40, trees: int = 4, rounds: int | None = None, gather: int = 40, emit: int = 10, least: float = 0.02, seed: int = 5) -> DataFrame:
    """(u, nb) for every node; nodes: u, code, scale. Rounds go on until few lists change, and at most half the logarithm of the nodes (six at least)."""
    rounds = rounds or max(6, int(np.ceil(np.log2(max(2, count)) / 2)))
    start = best_of(leaf_links(nodes, count, trees, min(k, 12), dims, seed), k)
    # A node that is alone in all its leaves still has a row.
    graph = nodes.select("u").join(start, "u", "left").select("u", F.coalesce("nb", F.array().cast("array<struct<ns:double,v:bigint>>")).alias("nb"))
    graph = materialize(graph.withColumn("fresh", F.transform("nb", lambda e: e["v"])), "graph")
    for turn in range(rounds):
        found = best_of(descend(graph, nodes, k, gather, emit, turn), k).withColumnRenamed("nb", "more")
        merged = graph.join(found, "u", "left").select("u", "nb", F.when(F.col("more").isNull(), F.col("nb")).otherwise(F.slice(F.sort_array(F.array_union("nb", "more")), 1, k)).alias("now"))
        old = F.transform("nb", lambda e: e["v"])
        new = materialize(merged.select("u", F.col("now").alias("nb"), F.array_except(F.transform("now", lambda e: e["v"]), old).alias("fresh")), "graph")
        discard(graph)
        graph = new
        if graph.agg(F.coalesce(F.sum(F.size("fresh")), F.lit(0)).alias("n")).first()["n"] <= least * k * count:
            break
    return graph.select("u", "nb")


def graph_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, heads: list[int], beam: int = 96, expand: int = 24) -> DataFrame:
    """(q, v): the nodes in each query's final beam, when no beam has a node left to expand. queries: q, code, scale.

    Every query starts at its own node and at heads; these few nodes and their neighbours go to all tasks, so no join meets them.
    """
    about = nodes.select(F.col("u").alias("v"), "code", "scale")
    rich = graph.select("u", F.explode(F.transform("nb", lambda e: e["v"])).alias("v")).join(about, "v").groupBy("u").agg(F.collect_list("v").alias("ids"), F.collect_list("code").alias("codes"), F.collect_list("scale").alias("scales"))
    rich = materialize(rich, "rich-graph")
    pair = "struct<ns:double,v:bigint>"
    state_schema = f"q bigint, code binary, scale double, beam array<{pair}>, done array<bigint>, todo array<bigint>"
    arrow_pair = pa.list_(pa.struct([("ns", pa.float64()), ("v", pa.int64())]))
    known = rich.where(F.col("u").isin(*heads)).collect()  # ENTRIES nodes with their neighbours
    entry: dict[int, tuple[bytes, float]] = {v: (bytes(c), s) for r in known for v, c, s in zip(r["ids"], r["codes"], r["scales"])}
    entry |= {r["v"]: (bytes(r["code"]), r["scale"]) for r in about.where(F.col("v").isin(*heads)).collect()}
    entry_ids = sorted(entry)
    entry_codes, entry_scales = [entry[v][0] for v in entry_ids], [entry[v][1] for v in entry_ids]
    seen_heads = {r["u"] for r in known}
    seeds = queries.select("q", F.col("q").alias("v")).join(about.withColumnRenamed("code", "c").withColumnRenamed("scale", "s"), "v")
    first = seeds.groupBy("q").agg(F.collect_list("v").alias("ids"), F.collect_list("c").alias("codes"), F.collect_list("s").alias("scales"))
    state = queries.select("q", "code", "scale", F.array().cast(f"array<{pair}>").alias("beam"), F.array().cast("array<bigint>").alias("done"), F.array().cast("array<bigint>").alias("todo"))
    finished: list[DataFrame] = []
    got = first
    nothing = lambda t: F.lit(None).cast(t)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            c = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.binary(), pa.float64(), arrow_pair, pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["q", "code", "scale", "beam", "done", "todo"])

        for q, rows in streamed(batches):
            own = next(r for r in rows if r[1] is not None)
            have = {e["v"]: e["ns"] for e in own[3]}
            done = set(own[4]) | set(own[5])
            ids = [v for r in rows if r[6] is not None for v in r[6]]
            codes = [c for r in rows if r[6] is not None for c in r[7]]
            scales = [s for r in rows if r[6] is not None for s in r[8]]
            if not have:
                ids, codes, scales, done = ids + entry_ids, codes + entry_codes, scales + entry_scales, done | seen_heads
            fresh: dict[int, int] = {}
            for i, v in enumerate(ids):
                if v not in have and v not in fresh:
                    fresh[v] = i
            if fresh:
                at = list(fresh.values())
                ns = -products(decode([own[1]]), np.array([own[2]]), decode([codes[i] for i in at]), np.array([scales[i] for i in at]))[0]
                have |= dict(zip(fresh, ns.tolist()))
            best = sorted((n, v) for v, n in have.items())[:beam]
            todo = [v for _, v in best if v not in done][:expand]
            out.append((q, own[1], own[2], [{"ns": n, "v": v} for n, v in best], sorted(done), todo))
            if len(out) >= 200:
                yield batch_of()
                out.clear()
        yield batch_of()

    while True:  # each round expands new nodes, so it ends
        left = state.select("q", "code", "scale", "beam", "done", "todo", nothing("array<bigint>").alias("ids"), nothing("array<binary>").alias("codes"), nothing("array<double>").alias("scales"))
        right = got.select("q", nothing("binary").alias("code"), nothing("double").alias("scale"), nothing(f"array<{pair}>").alias("beam"), nothing("array<bigint>").alias("done"), nothing("array<bigint>").alias("todo"), "ids", "codes", "scales")
        now = materialize(left.unionByName(right).repartition("q").sortWithinPartitions("q").mapInArrow(step, state_schema), "beams")
        finished.append(now.where(F.size("todo") == 0).select("q", F.transform("beam", lambda e: e["v"]).alias("vs")))
        state = now.where(F.size("todo") > 0)
        free_shuffles(nodes.sparkSession)
        if state.isEmpty():
            break
        got = state.select("q", F.explode("todo").alias("u")).join(rich, "u").select("q", "ids", "codes", "scales")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("q", F.explode("vs").alias("v"))


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **graph_options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a Column) holds, the k nearest other rows found."""
    kind = df.schema[id_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`")
    if df.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), F.size("v").alias("d"))
    empty = df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    rows = materialize(rows, "vectors")
    out = empty
    # Vectors of a length are an index of their own.
    for r in rows.groupBy("d").agg(F.bool_or("asks").alias("asked")).where("asked").orderBy("d").collect():
        out = out.unionByName(nearest_of_length(rows.where(F.col("d") == r["d"]).drop("d"), r["d"], k, kind, **graph_options))
    return out


def nearest_of_length(rows: DataFrame, dims: int, k: int, kind: str, **graph_options) -> DataFrame:
    """nearest() of rows (id, v, asks, k1, k2) of one length."""
    # A class passes on its k + 1 smallest ids: a query leaves out its own.
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("rn") <= k + 1)
    classes = materialize(first.groupBy("k1", "k2").agg(F.min_by("v", "rn").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("u", F.xxhash64("k1", "k2")), "classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = classes.agg(F.max(norm).alias("m"), F.count("*").alias("n")).first()
    longest, count = stats["m"] * (1 + 1e-12), stats["n"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, s = encode(np.array(batch.column(1).to_pylist(), float), longest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in c], pa.binary()), pa.array(s)], names=["u", "code", "scale"])

    nodes = materialize(classes.select("u", "v").mapInArrow(code, "u bigint, code binary, scale double"), "nodes")
    graph = build_graph(nodes, count, dims, **graph_options)
    asking = rows.where("asks").select("id", F.xxhash64("k1", "k2").alias("q"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                c, s = encode(x / np.linalg.norm(x, axis=1, keepdims=True), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([y.tobytes() for y in c], pa.binary()), pa.array(s)], names=["q", "code", "scale"])

    queries = asking.select("q").distinct().join(classes.select(F.col("u").alias("q"), "v"), "q").select("q", "v").mapInArrow(ask, "q bigint, code binary, scale double")
    # Besides its own node, a query starts at the longest vectors, where large inner products are; few, whatever the data.
    heads = [r["u"] for r in classes.orderBy(norm.desc(), "u").limit(ENTRIES).select("u").collect()]
    found = graph_search(graph, nodes, queries, heads, beam=max(96, 4 * k))
    own = classes.select(F.col("u").alias("q"), F.col("v").alias("x"))
    other = classes.select(F.col("u").alias("v"), F.col("v").alias("y"), "ids")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(other, "v").join(own, "q").select("q", dot.alias("score"), F.explode("ids").alias("vec_id"))
    # Each query class keeps enough for any of its members to leave itself out.
    best = scored.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("ns"), "vec_id"))), 1, k + 1).alias("best"))
    out = asking.join(materialize(best, "found"), "q").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda e: e["vec_id"] != F.col("id")), 1, k).alias("best"))
    out = out.select("query_id", F.posexplode("best").alias("pos", "e"))
    return out.select(F.col("query_id").cast(kind).alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").cast(kind).alias("vec_id"), (-F.col("e.ns")).alias("score"))
