"""Embedding near-duplicates: int8 quantised tile products with rigorous per-vector error bounds.

Vectors are compared only under equal labels, by cosine. Equal vectors of a label are one class, compared once.

1. Each class's unit vector u becomes q * s: int8 codes q and a scale s, with the exact error e = |u - s q|.
   For unit u, v: |u.v - (s q).(t r)| <= e + f + e f. Codes are made once and are all that tiles hold and ship.
2. The classes of a label are sorted along a direction into slots and cut into tiles, each with a centre and a radius
   that holds its true vectors; a pair of tiles whose angle between centres less both radii is above the threshold's
   angle is left out, which loses no pair.
3. A tile pair is one product of code matrices. Pairs whose quantised cosine plus bound is below the threshold are
   out, those whose quantised cosine less bound is not below it are links. The others get the same test with the int8
   codes of what the first codes leave over, whose bound is some 250 times narrower; those still open are joined
   with the original vectors and computed again in double precision.
4. A tile pair passes on its links as sums by vector and as a spanning forest, so its rows grow with its vectors,
   not their square; components by star contraction.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows with a null
label, are in the result and link with nothing; a vector of another length links only with its like;
repeated rows (same id) are one vector each, linked if their vectors are (classes of vectors with the same smallest
id are one component); other columns, whatever they are
called, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Vectors to a tile; two tiles of float32 work space are what a task holds.
TILE = 512
#: Width of a slot along the direction by which tiles are cut.
SLOT = 0.0625


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors) of unit rows; the errors are exact up to double rounding, and rounded up."""
    scale = np.maximum(np.abs(unit).max(1) / 127, 1e-300)
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error * (1 + 1e-9) + 1e-12


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def refine(unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """quantise() of unit rows, and of what those codes leave over: both codes together are within the second errors."""
    first = quantise(unit)
    return [first, quantise(unit - first[0] * first[1][:, None])]


def by_length(vectors: list) -> Iterator[tuple[list[int], np.ndarray]]:
    """(places, their unit rows) for each length that occurs."""
    for d in sorted({len(v) for v in vectors}):
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        yield at, unit_rows([vectors[i] for i in at])


def judge_pairs(a: list, b: list, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(sure, open): which pairs of rows of two tiles, each as of refine(), have a cosine >= threshold, and which the bounds leave open."""
    (q, s, e), (r, t, f) = a[0], b[0]
    # Sums of products of int8 codes stay below 2**24 for up to 1040 components, where float32 is exact.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    near = (q.astype(kind) @ r.astype(kind).T) * (s[:, None] * t[None])
    bound = e[:, None] + f[None] + e[:, None] * f[None]
    sure, maybe = near - bound >= threshold, near + bound >= threshold
    if same:
        sure, maybe = np.triu(sure, 1), np.triu(maybe, 1)
    unsure = maybe & ~sure
    i, j = np.nonzero(unsure)
    x, y = ((one[0][0] * one[0][1][:, None] + one[1][0] * one[1][1][:, None]) for one in (a, b))
    e, f = a[1][2], b[1][2]
    for at in range(0, len(i), 65536):
        m, n = i[at : at + 65536], j[at : at + 65536]
        near, bound = np.einsum("ij,ij->i", x[m], y[n]), e[m] + f[n] + e[m] * f[n]
        sure[m, n], unsure[m, n] = near - bound >= threshold, (near - bound < threshold) & (near + bound >= threshold)
    return sure, unsure


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what a symmetric matrix of links connects: fewer than its rows."""
    left, out = np.ones(len(linked), bool), []
    for root in np.nonzero(linked.any(1))[0]:
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            u = todo.pop()
            new = np.nonzero(linked[u] & left)[0]
            left[new] = False
            todo.extend(new)
            out.append((np.full(len(new), u), new))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """id_col, n_links, component_id, kept: a row for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`")
    if df.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vector.alias("v"))
    fit = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("fit", fit)
    # Classes of equal vectors: 128 bits of hash stand for the vector.
    key = [F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label")]
    members = materialize(rows.where("fit").select("id", "label", key[0].alias("k1"), key[1].alias("k2"), "v"), "vectors")
    classes = members.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes, "classes")

    # Along a fixed unit direction w: |w.u - w.v| <= |u - v|, so classes in slots further apart than the threshold's chord can't link.
    wave = lambda i: F.sin(i * 12.9898)
    places = F.sequence(F.lit(1), F.size("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    along = total(F.zip_with("v", places, lambda x, i: x.cast("double") * wave(i)))
    norms = F.sqrt(total(F.transform("v", lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(places, lambda i: wave(i) * wave(i))))
    placed = classes.withColumn("d", F.size("v")).withColumn("slot", F.floor(F.coalesce(F.try_divide(along, norms), F.lit(0.0)) / SLOT).cast("int"))
    sizes = placed.groupBy("label", "d", "slot").agg(F.count("*").alias("n"))
    placed = placed.join(sizes.select(F.col("label").alias("l_"), F.col("d").alias("d_"), F.col("slot").alias("s_"), "n"), (F.col("label") == F.col("l_")) & (F.col("d") == F.col("d_")) & (F.col("slot") == F.col("s_"))).drop("l_", "d_", "s_")
    # A slot of n classes is dealt by hash into n / tile tiles: each holds about tile classes.
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "rep"), F.ceil(F.col("n") / tile)).cast("int")).withColumn("tile", F.xxhash64("label", "d", "slot", "part"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = [([b""] * n, np.zeros(n), np.zeros(n)) for _ in range(2)]
            for at, u in by_length(batch.column(6).to_pylist()):
                for (codes, scales, errors), (q, scale, error) in zip(out, refine(u)):
                    scales[at], errors[at] = scale, error
                    for i, row in zip(at, q):
                        codes[i] = row.tobytes()
            coded = [pa.array(c, t) for one in out for c, t in zip(one, (pa.binary(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *coded], names=[*names, *parts])

    names = ["tile", "label", "d", "slot", "rep", "k1"]
    parts = ["codes", "scale", "error", "codes2", "scale2", "error2"]
    coded = placed.select(*names, "v", "size").withColumn("rep", F.struct("rep", "size")).mapInArrow(code, "tile bigint, label string, d int, slot int, rep struct<rep:bigint,size:bigint>, k1 bigint, codes binary, scale double, error double, codes2 binary, scale2 double, error2 double")
    # By the tile alone: keyed by label and slot as well, the counts' partitioning above would do, and a hot slot would be one task.
    row = F.struct(F.col("rep.rep").alias("rep"), "k1", F.col("rep.size").alias("size"), *parts)
    tiles = materialize(coded.groupBy("tile").agg(F.first("label").alias("label"), F.first("d").alias("d"), F.first("slot").alias("slot"), F.collect_list(row).alias("rows")), "tiles")

    angle = float(np.arccos(threshold))

    def opened(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes = lambda c: np.frombuffer(b"".join(r[c] for r in rows), np.int8).reshape(len(rows), -1)
        return [(codes(c), np.array([r[s] for r in rows]), np.array([r[e] for r in rows])) for c, s, e in (parts[:3], parts[3:])]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for own in batch.column(4).to_pylist():
                q, _, e = opened(own)[0]
                u = q.astype(float)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                c = u.mean(0)
                n = np.linalg.norm(c)
                c = c / n if n > 1e-9 else u[0]
                centres.append(c)
                # A unit vector is at most asin(e) off its codes' direction.
                radii.append(float((np.arccos(np.clip(u @ c, -1, 1)) + np.arcsin(np.minimum(e, 1))).max()) + 1e-6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["tile", "label", "d", "slot", "centre", "radius"])

    about = materialize(tiles.select("tile", "label", "d", "slot", "rows").mapInArrow(summary, "tile bigint, label string, d int, slot int, centre array<double>, radius double"), "tile-bounds")
    # Each tile meets those of its slot and of the slots above it within reach, so a label's pairs are dealt by slot.
    chord = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    reach = int(chord / SLOT) + 1
    left, right = about.select(*[F.col(c).alias(f"a_{c}") for c in about.columns]), about.select(*[F.col(c).alias(f"b_{c}") for c in about.columns])
    left = left.withColumn("meets", F.explode(F.sequence(F.col("a_slot"), F.col("a_slot") + reach)))
    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    pairs = left.join(right, (F.col("a_label") == F.col("b_label")) & (F.col("a_d") == F.col("b_d")) & (F.col("meets") == F.col("b_slot")))
    pairs = pairs.where((F.col("a_slot") < F.col("b_slot")) | (F.col("a_tile") <= F.col("b_tile")))
    pairs = pairs.where(between - F.col("a_radius") - F.col("b_radius") <= angle + 1e-6).select("a_tile", "b_tile")
    a, b = tiles.select(F.col("tile").alias("a_tile"), F.col("rows").alias("a_rows")), tiles.select(F.col("tile").alias("b_tile"), F.col("rows").alias("b_rows"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x, y, same = one.column(2)[0].as_py(), one.column(3)[0].as_py(), one.column(0)[0] == one.column(1)[0]
                sure, unsure = judge_pairs(opened(x), opened(y), same, threshold)
                rows = x if same else x + y
                rep, key, size = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "k1", "size"))
                if not same:  # the rows of both tiles are one matrix
                    m = len(x)
                    both = np.zeros((2, len(rows), len(rows)), bool)
                    both[0, :m, m:], both[1, :m, m:] = sure, unsure
                    sure, unsure = both
                linked = sure | sure.T
                for kind, (i, j), n in (
                    ("count", (linked.any(1).nonzero()[0],) * 2, linked @ size),
                    ("link", forest(linked), size),
                    ("open", np.nonzero(unsure), size),
                ):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(i), pa.string()), *(pa.array(c) for c in (rep[i], key[i], rep[j], key[j], n[i], n[j]))], names=["kind", "a", "ak", "b", "bk", "na", "nb"])

    found_schema = "kind string, a bigint, ak bigint, b bigint, bk bigint, na bigint, nb bigint"
    todo = pairs.join(a, "a_tile").join(b, "b_tile").select("a_tile", "b_tile", "a_rows", "b_rows")
    judged = materialize(todo.mapInArrow(products, found_schema), "tile-products", by="kind")

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            keep = np.zeros(len(x), bool)
            for at, u in by_length(x):
                keep[at] = np.einsum("ij,ij->i", u, unit_rows([y[i] for i in at])) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:6]], names=["a", "ak", "b", "bk", "na", "nb"])

    pair = ["a", "ak", "b", "bk", "na", "nb"]
    exact = judged.where(F.col("kind") == "open").select(pair)
    for side in "ab":
        exact = exact.join(classes.select(F.col("rep").alias(side), F.col("k1").alias(f"{side}k"), F.col("v").alias(f"{side}v")), [side, f"{side}k"])
    exact = materialize(exact.select(*pair, "av", "bv").mapInArrow(recompute, "a bigint, ak bigint, b bigint, bk bigint, na bigint, nb bigint"), "exact-links")
    links = judged.where(F.col("kind") == "link").select("a", "b").union(exact.select("a", "b"))
    counts = judged.where(F.col("kind") == "count").select("a", "ak", F.col("na").alias("n"))
    counts = counts.union(exact.select("a", "ak", F.col("nb"))).union(exact.select("b", "bk", F.col("na")))
    counts = counts.groupBy("a", "ak").agg(F.sum("n").alias("outside"))
    found = components(links)
    info = classes.select("k1", "k2", "rep", "size").join(counts, (F.col("rep") == F.col("a")) & (F.col("k1") == F.col("ak")), "left").join(found, F.col("rep") == F.col("id"), "left").select("k1", "k2", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = members.select("id", "k1", "k2").join(info, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("fit")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
