"""Connected components of links between rows, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


def gathered(batches: Iterator[pa.RecordBatch]) -> Union:
    found = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.join(a, b)
    return found


#: Vertices that a task holds at a time.
HELD = 1_000_000


def contract(links: DataFrame, held: int = HELD) -> DataFrame:
    """Each partition's links (a, b), `held` vertices at a time, as stars around their components' smallest members: at most one row a vertex."""

    def stars(found: Union) -> Iterator[pa.RecordBatch]:
        rows = [(x, found.find(x)) for x in list(found.parent)]
        rows = [(x, r) for x, r in rows if x != r]
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Union()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.join(a, b)
            if len(found.parent) > held:
                yield from stars(found)
                found = Union()
        yield from stars(found)

    return links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).mapInArrow(work, "a bigint, b bigint")


#: Contracted links up to this many are finished by one task, whose memory they bound; more go through rounds of joins.
ONE_TASK = 500_000


def finish_in_one_task(links: DataFrame) -> DataFrame:
    """(id, component) of at most ONE_TASK links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(batches)
        ids = list(found.parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([found.find(x) for x in ids], pa.int64())], names=["id", "component"])

    return links.select("a", "b").repartition(1).mapInArrow(work, "id bigint, component bigint")


def components(links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in links (a, b); ids without links are left out.

    Every round writes its links to the shared folder, so lineage stays short. Sums and minima by key are
    partial before the shuffle, and contracted links are a forest, so no vertex gathers many rows.
    """
    edges = materialize(contract(links).where("a <> b"), "links")
    if edges.count() <= one_task:
        return materialize(finish_in_one_task(edges), "components")
    before = None
    for _ in range(max_rounds):
        # Large-star: larger neighbours to the smallest of the neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small-star: a vertex and its smaller neighbours to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = materialize(small, "links")
        discard(edges)
        edges = new
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == sums:
            break
        before = sums
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
