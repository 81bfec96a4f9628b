"""Hard negatives by a vector-approximation file: cells of each dimension, bounds on scores by table lookup, exact scores for few.

Components become integers floor(scale * x), a score is the integer inner product with an anchor. An anchor's positives
are its `positives` best other rows of its label; for each of them, the `negatives` best rows of other labels whose score is
within [low, high] percent of the positive's.

1. The file: every dimension is cut into at most 2**bits cells (bits up to 8) at quantiles of about `fit_rows` rows (chosen by hash; they decide how
   tight bounds are, never the result); the ends of the outer cells are the least and greatest value of all rows. Rows are dealt by hash into blocks of
   about BLOCK rows, each a table entry of cell numbers by dimension, rows of a label together.
2. Anchors, in blocks of ANCHORS, meet all blocks of the file. An anchor has a table of the least and greatest product for each
   dimension and cell; a row's bounds are sums of entries of it. For positives, rows of the label stay whose upper bound
   reaches the block's k-th best lower bound; for negatives, rows that may lie in a positive's window stay,
   unless the block has k rows surely inside it with better lower bounds.
3. The best such floor of any block holds for the anchor, and what is below it goes. Only what stays is joined with the integers and
   scored exactly.

Every anchor is compared with every row by cell numbers, so work is anchors times rows: the anchors are the query set.

Tables of whole numbers and blocks are far smaller as files than in memory, so no join is left to Spark's estimate of a size: all
are by sort and merge, but that with the anchors' numbers while these take HELD bytes at most.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of different
lengths don't meet; an empty vector scores 0 with its like; rows that repeat an id, label and vector are one row, other rows
under one id are rows of their own; ties go to the smaller id, then by a hash of the row; scores beyond 64 bits are
held at their ends; an empty table gives an empty result; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BITS, FIT_ROWS = 8, 20_000
BLOCK, ANCHORS = 4096, 64
LONG = (1 << 63) - 1
#: Bytes of anchors' numbers that go to all tasks.
HELD = 16 << 20
#: Products of doubles are widened by this share for rounding.
SLACK = 1e-9


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, held at 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = np.einsum("ij,ij->i", np.abs(a), np.abs(b)) < 1 << 52
        out = np.where(small, np.einsum("ij,ij->i", a, b), 0.0).astype(np.int64)
    for i in np.flatnonzero(~small):
        total = sum(int(p) * int(q) for p, q in zip(a[i].tolist(), b[i].tolist()))
        out[i] = max(-LONG, min(LONG, total))
    return out


class Cells:
    """Where the cells of each dimension begin and end."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        places = np.arange(1, 1 << bits) / (1 << bits)
        self.edges = [np.unique(np.quantile(c, places, method="higher")) if len(c) else np.zeros(0) for c in sample.T]
        self.size = 1 << bits
        # A cell holds whole numbers from its edge to below the next; what it lacks is never looked up.
        self.low, self.high = np.zeros((2, len(self.edges), self.size))
        for j, edges in enumerate(self.edges):
            self.low[j, : len(edges) + 1] = np.concatenate([[least[j]], edges])
            self.high[j, : len(edges) + 1] = np.concatenate([edges - 1, [most[j]]])
        self.peak = np.maximum(np.abs(least), np.abs(most))

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each component, by dimension."""
        return np.array([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, rows.T)], np.uint8).reshape(rows.shape[1], len(rows))

    def table(self, anchor: np.ndarray) -> tuple[np.ndarray, float]:
        """(least and greatest product of each dimension and cell as one complex number, slack)."""
        out = np.empty(self.low.shape, complex)
        with np.errstate(over="ignore"):
            a, b = anchor[:, None] * self.low, anchor[:, None] * self.high
            out.real, out.imag = np.minimum(a, b), np.maximum(a, b)
            return out.reshape(-1), float(np.abs(anchor) @ self.peak) * SLACK


def bounds(table: np.ndarray, slack: float, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the rows whose table entries are at places, a row of them a dimension."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = table[places].sum(0)
        lower, upper = total.real - slack, total.imag + slack
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest, or minus infinity where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def integers(df: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, tag, label, d, x) of the rows that take part; x: whole numbers as doubles; tag: a hash that tells rows of one id."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    most = float(np.finfo(np.float64).max)

    def down(x: Column) -> Column:
        """The floor as a double; what is beyond doubles stays at their ends, where any score is beyond 64 bits."""
        y = F.when(F.abs(x) > most / scale, F.signum(x) * most).otherwise(x * scale)
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0) + F.lit(0.0)

    scaled = F.transform("v", down)
    return rows.select("id", F.xxhash64("label", "v").alias("tag"), "label", F.size("v").alias("d"), scaled.alias("x"))


def fitted(rows: DataFrame, count: int, bits: int, fit_rows: int) -> dict[int, Cells]:
    """The cells of each vector length."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, list] = {}
        for batch in batches:
            for d in np.unique(batch.column(0).to_numpy()).tolist():
                own = [v for v in batch.column(1).to_pylist() if len(v) == d]
                x = np.array(own, np.float64).reshape(len(own), d)
                a, b = low.get(d, (np.full(d, np.inf), np.full(d, -np.inf)))
                low[d] = np.minimum(a, x.min(0)), np.maximum(b, x.max(0))
        c = [(d, j, a[j], b[j]) for d, (a, b) in low.items() for j in range(d)]
        c = list(zip(*c)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64())], names=["d", "j", "low", "high"])

    found: dict[int, dict[int, tuple]] = {}
    for r in rows.select("d", "x").mapInArrow(ends, "d int, j int, low double, high double").groupBy("d", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row a dimension
        found.setdefault(r["d"], {})[r["j"]] = (r["low"], r["high"])
    chosen = rows.where(F.pmod(F.xxhash64("id", "tag"), F.lit(1 << 40)) <= int((1 << 40) * min(1, fit_rows / max(1, count))))
    sample: dict[int, list] = {}
    for r in chosen.select("d", "x").collect():  # about fit_rows
        sample.setdefault(r["d"], []).append(r["x"])
    out = {}
    for d in {r for r in sample} | set(found):
        own = found.get(d, {})
        out[d] = Cells(np.array(sample.get(d, []), np.float64).reshape(len(sample.get(d, [])), d), np.array([own[j][0] for j in range(d)]), np.array([own[j][1] for j in range(d)]), bits)
    return out


def approximation_file(rows: DataFrame, cells, blocks: int) -> DataFrame:
    """(block, d, ids, tags, labels, cuts, codes): labels[i] has the rows cuts[i]..cuts[i + 1]."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        names = np.array(table["label"].to_pylist(), object)
        order = np.lexsort((table["id"].to_numpy(), names.astype(str)))
        names, d = names[order], table["d"][0].as_py()
        x = np.array(table["x"].to_pylist(), np.float64).reshape(len(names), d)[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        codes = cells.value[d].codes(x)
        ids, tags = (table[c].to_numpy()[order] for c in ("id", "tag"))
        return pa.table({"block": table["block"][:1], "d": table["d"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "tags": pa.array([tags.tobytes()], pa.binary()), "labels": pa.array([names[first].tolist()], pa.list_(pa.string())), "cuts": pa.array([[*first.tolist(), len(names)]], pa.list_(pa.int32())), "codes": pa.array([codes.tobytes()], pa.binary())})

    return materialize(dealt.groupBy("block", "d").applyInArrow(pack, "block int, d int, ids binary, tags binary, labels array<string>, cuts array<int>, codes binary"), "vector-file")


def scanned(file: DataFrame, anchors: DataFrame, cells, blocks: int, count: int, pick_rows, extra: str) -> DataFrame:
    """(a, at, k, id, tag, upper, floor): what pick_rows leaves of each block for each anchor; anchors: id, tag, label, d, x and the column `extra`."""
    groups = max(1, -(-count // ANCHORS))
    packed = anchors.withColumn("g", F.pmod(F.xxhash64("tag", "id"), F.lit(groups))).groupBy("d", "g").agg(F.collect_list(F.struct("id", "tag", "label", "x", extra)).alias("own"))
    # Every block of anchors goes to every block of the file.
    meet = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(file.hint("merge"), ["d", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, tags, labels, cuts, codes, own in zip(*(c.to_pylist() for c in batch.columns)):
                c = cells.value[d]
                ids, tags = np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64)
                places = np.frombuffer(codes, np.uint8).reshape(d, len(ids)).astype(np.intp) + np.arange(d)[:, None] * c.size
                at = {name: (cuts[i], cuts[i + 1]) for i, name in enumerate(labels)}
                out: list[tuple] = []
                for anchor in own:
                    table, slack = c.table(np.array(anchor["x"], np.float64))
                    for k, rows, upper, floor in pick_rows(anchor, table, slack, places, at.get(anchor["label"], (0, 0)), ids, tags):
                        n = len(rows)
                        out.append((np.full(n, anchor["id"]), np.full(n, anchor["tag"]), np.full(n, k), ids[rows], tags[rows], upper, np.full(n, floor)))
                if out:
                    cols = [np.concatenate(x) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["a", "at", "k", "id", "tag", "upper", "floor"])

    found = materialize(meet.select("d", "ids", "tags", "labels", "cuts", "codes", "own").mapInArrow(work, "a bigint, at bigint, k int, id bigint, tag bigint, upper double, floor double"), "approximate")
    best = found.groupBy("a", "at", "k").agg(F.max("floor").alias("best"))
    return found.join(best.hint("merge"), ["a", "at", "k"]).where(F.col("upper") >= F.col("best")).select("a", "at", "k", "id", "tag")


def scored(pairs: DataFrame, rows: DataFrame, anchors: DataFrame, held: bool) -> DataFrame:
    """pairs (a, at, id, tag) with their exact score; held: the anchors' numbers go to all tasks."""
    one = anchors.select(F.col("id").alias("a"), F.col("tag").alias("at"), F.col("x").alias("ax"))
    one = F.broadcast(one) if held else one.hint("merge")
    both = pairs.join(rows.select("id", "tag", "x").hint("merge"), ["id", "tag"]).join(one, ["a", "at"]).select("a", "at", "id", "tag", "ax", "x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, length = np.zeros(batch.num_rows, np.int64), np.diff(batch.column(4).offsets.to_numpy())
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                rows = batch.take(pa.array(own))
                total[own] = exact(*(rows.column(i).flatten().to_numpy().reshape(len(own), d) for i in (4, 5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(total)], names=["a", "at", "id", "tag", "score"])

    return both.mapInArrow(work, "a bigint, at bigint, id bigint, tag bigint, score bigint")


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bits: int = BITS, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor: a condition on df's columns."""
    spark = df.sparkSession
    marked = df.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"), F.col(f"`{label_col}`"), F.coalesce(is_anchor, F.lit(False)).alias("datassay_anchor"))
    every = marked.where("datassay_anchor").select(F.col(f"`{id_col}`").cast("bigint").alias("id")).distinct()
    rows = materialize(integers(marked, scale, id_col, vector_col, label_col).dropDuplicates(["id", "tag"]), "integers")
    count = rows.count()
    blocks = max(1, -(-count // block))
    cells = spark.sparkContext.broadcast(fitted(rows, count, bits, fit_rows))  # some 2**bits numbers a dimension
    file = approximation_file(rows, cells, blocks)
    anchors = materialize(rows.join(every.hint("merge"), "id", "left_semi"), "anchors")
    number, wide = anchors.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    held = 64 * number + 8 * wide <= HELD

    def alike(anchor, table, slack, places, own, ids, tags):
        at = np.arange(*own)
        at = at[(ids[at] != anchor["id"]) | (tags[at] != anchor["tag"])]
        if len(at):
            lower, upper = bounds(table, slack, places[:, at])
            floor = kth(lower, positives)
            good = upper >= floor
            yield 0, at[good], upper[good], floor

    found = scored(scanned(file, anchors.withColumn("none", F.lit(0)), cells, blocks, number, alike, "none").drop("k"), rows, anchors, held)
    nearest = Window.partitionBy("a", "at").orderBy(F.desc("score"), "id", "tag")
    best = materialize(found.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= positives), "positives")
    lists = best.groupBy("a", "at").agg(F.collect_list(F.struct("k", "score")).alias("windows"))  # at most `positives` a row
    asked = anchors.join(lists.select(F.col("a").alias("id"), F.col("at").alias("tag"), "windows").hint("merge"), ["id", "tag"])

    def unlike(anchor, table, slack, places, own, ids, tags):
        lower, upper = bounds(table, slack, places)
        other = np.ones(len(ids), bool)
        other[own[0] : own[1]] = False
        for w in anchor["windows"]:
            from_, to = -((-low * w["score"]) // 100), high * w["score"] // 100
            if from_ <= to:
                floor = kth(lower[other & (lower >= from_) & (upper <= to)], negatives)
                good = np.flatnonzero(other & (upper >= max(from_, floor)) & (lower <= to))
                if len(good):
                    yield w["k"], good, upper[good], floor

    near = materialize(scanned(file, asked, cells, blocks, number, unlike, "windows"), "near")
    exactly = scored(near.drop("k").distinct(), rows, anchors, held)
    pos = best.select("a", "at", "k", F.col("id").alias("positive_id"), F.col("tag").alias("positive_tag"), F.col("score").alias("positive_score"))
    big = lambda c: F.col(c).cast("decimal(28,0)")
    inside = near.join(exactly.hint("merge"), ["a", "at", "id", "tag"]).join(pos.hint("merge"), ["a", "at", "k"]).where((big("positive_score") * low <= big("score") * 100) & (big("score") * 100 <= big("positive_score") * high))
    rank = F.row_number().over(Window.partitionBy("a", "at", "k").orderBy(F.desc("score"), "id", "tag"))
    out = inside.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select(F.col("a").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
