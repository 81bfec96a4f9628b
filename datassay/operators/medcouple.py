"""The medcouple of columns of any size, over all their values.

A pair of distances u above and l below the median has the kernel (u - l) / (u + l), which grows with u / l, so the medcouple is
asked for as places among all ratios; pairs with the median itself are counted, not made. Pairs are never listed: for each u, the l
with u / l <= r begin at one place of the sorted l, so a search counts all pairs up to r, and r is narrowed over doubles until
one is left.

1. Each side of a column is cut into parts of about SLOT_ROWS distinct distances by a directory; a part is one row.
2. A column with one part a side is finished in a task. Otherwise the parts' ends bound the places asked for, and only parts whose pairs
   can lie within the bounds meet, once; each pass then counts FAN_OUT ratios at once.

What reaches the driver: four numbers a part, and the counts asked for.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import directories, sizes, slot_of

#: Ratios counted in one pass for one place.
FAN_OUT = 15
#: The bits of infinity: doubles from 0 on are ordered as their bits are.
LAST = 0x7FF << 52


def double(bits: int) -> float:
    """The double of these bits; below all for -1."""
    return float(np.array([bits], np.int64).view(np.float64)[0]) if bits >= 0 else -1.0


def search(u: np.ndarray, l: np.ndarray, r: float, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each u the first place in l, between least and most, from which u / l <= r; l ascends."""
    low, high = least.copy(), most.copy()
    with np.errstate(over="ignore", under="ignore", divide="ignore"):
        # Nearly all are where u / r is in l; what rounding moves is searched for.
        left = np.flatnonzero(low < high)
        own, a, b = u[left], low[left], high[left]
        at = np.clip(np.searchsorted(l, own / r), a, b)
        sure = ((at == a) | (own / l[at - 1] > r)) & ((at == b) | (own / l[np.minimum(at, len(l) - 1)] <= r))
        low[left[sure]] = high[left[sure]] = at[sure]
        while len(left := np.flatnonzero(low < high)):
            mid = (low[left] + high[left]) >> 1
            good = u[left] / l[mid] <= r
            high[left[good]] = mid[good]
            low[left[~good]] = mid[~good] + 1
    return low


def after(n: np.ndarray) -> np.ndarray:
    """The sums of n from each place on, and 0."""
    return np.append(np.cumsum(n[::-1])[::-1], 0)


def product_sum(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of products of whole numbers, beyond 64 bits too."""
    if int(a.sum()) * int(b.max(initial=0)) < 1 << 62:
        return int(a @ b)
    # 20 bits of b at a time: a's sum is below 2**43.
    return sum(int(a @ (b >> s & 0xFFFFF)) << s for s in (0, 20, 40, 60))


def counted(u: np.ndarray, un: np.ndarray, l: np.ndarray, ln: np.ndarray, ratios: list[float]) -> list[int]:
    """How many pairs have u / l <= r, for each of the ratios, which ascend."""
    rest, none = after(ln), np.zeros(len(u), np.int64)
    top = search(u, l, ratios[0], none, none + len(l))
    bottom = search(u, l, ratios[-1], none, top)
    out = []
    for r in ratios:
        top = search(u, l, r, bottom, top)
        out.append(product_sum(un, rest[top]))
    return out


def selected(u: np.ndarray, un: np.ndarray, l: np.ndarray, ln: np.ndarray, place: int) -> float:
    """The ratio at a 0-based place among all pairs' ratios, in order."""
    rest, low, high = after(ln), -1, LAST
    bottom, top = np.zeros(len(u), np.int64), np.full(len(u), len(l), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        at = search(u, l, double(mid), bottom, top)
        if product_sum(un, rest[at]) > place:
            high, bottom = mid, at
        else:
            low, top = mid, at
    return double(high)


def bounded(upper: list, lower: list, place: int) -> tuple[int, int]:
    """Bits (low, high) with the ratio at a place above low and at most high, by the ends of parts: rows (low, high, n) in order."""
    (ua, ub, un), (la, lb, ln) = (tuple(map(np.array, zip(*x))) for x in (upper, lower))

    def least(u, l, most):
        """The first bits up to which there are more than `most` pairs."""
        low, high = -1, LAST
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if counted(u, un, l, ln, [double(mid)])[0] > most else (mid, high)
        return high

    return least(ua, lb, place) - 1, least(ub, la, place)


def parts_of(nums: DataFrame, medians: dict[str, float]) -> DataFrame:
    """(col, side, slot, low, high, rows, z, n): distances from the median, above (1) and below (-1), cut into parts."""
    mid = nums.sparkSession.createDataFrame(list(medians.items()), "c_ string, mid double")  # a row a column
    # Halves, as a difference of large numbers may be no double.
    z = F.col("num") / 2 - F.col("mid") / 2
    sides = nums.join(F.broadcast(mid), F.col("col") == F.col("c_")).select(F.concat(F.when(z > 0, "+").otherwise("-"), "col").alias("col"), F.abs(z).alias("num"), "n").where("num > 0")
    placed = sides.withColumn("slot", slot_of(directories(sides, sizes(sides))))

    def pack(table: pa.Table) -> pa.Table:
        z, n = table["num"].to_numpy(), table["n"].to_numpy()
        at = np.argsort(z)
        z, n = z[at], n[at]
        key = table["col"][0].as_py()
        rows = {"col": key[1:], "side": 1 if key[0] == "+" else -1, "slot": table["slot"][0].as_py(), "low": z[0], "high": z[-1], "rows": int(n.sum()), "z": z.tobytes(), "n": n.tobytes()}
        return pa.Table.from_pylist([rows], pa.schema([("col", pa.string()), ("side", pa.int32()), ("slot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("rows", pa.int64()), ("z", pa.binary()), ("n", pa.binary())]))

    return placed.groupBy("col", "slot").applyInArrow(pack, "col string, side int, slot int, low double, high double, rows bigint, z binary, n binary")


def arrays(batch: pa.RecordBatch, *columns: str):
    """The rows of a batch, binary columns of them as numbers."""
    kinds = {"u": np.float64, "un": np.int64, "l": np.float64, "ln": np.int64}
    for i in range(batch.num_rows):
        yield [np.frombuffer(batch.column(c)[i].as_py(), kinds[c]) if c in kinds else batch.column(c)[i].as_py() for c in columns]


def ratios_at(parts: DataFrame, known: list, places: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """{(col, place): ratio}; known: the parts' (col, side, slot, low, high, rows)."""
    spark = parts.sparkSession
    ends: dict[tuple[str, int], list] = {}
    for r in sorted(known, key=lambda r: (r["col"], r["side"], r["slot"])):
        ends.setdefault((r["col"], r["side"]), []).append(r)
    bounds, meet, base = {}, [], {}
    for c, own in places.items():
        up, down = ([(r["low"], r["high"], r["rows"]) for r in ends[c, s]] for s in (1, -1))
        if len(up) == len(down) == 1:
            meet.append((c, ends[c, 1][0]["slot"], ends[c, -1][0]["slot"], sorted(own)))
            continue
        for p in own:
            bounds[c, p] = bounded(up, down, p)
        low, high = double(min(bounds[c, p][0] for p in own)), double(max(bounds[c, p][1] for p in own))
        (ua, ub, un), (la, lb, ln) = (tuple(map(np.array, zip(*x))) for x in (up, down))
        none = np.zeros(len(up), np.int64)
        # Of each upper part, the lower ones before `first` have no pair up to high, those from `last` on only pairs up to low.
        first, last = search(ua, lb, high, none, none + len(down)), search(ub, la, low, none, none + len(down))
        base[c] = product_sum(un, after(ln)[last])
        meet += [(c, ends[c, 1][i]["slot"], ends[c, -1][j]["slot"], None) for i in range(len(up)) for j in range(first[i], last[i])]
    side = lambda s, *names: parts.where(F.col("side") == s).select("col", *[F.col(a).alias(b) for a, b in zip(("slot", "z", "n"), names)])
    pairs = F.broadcast(spark.createDataFrame(meet, "col string, a int, b int, places array<bigint>"))  # a few rows a part
    band = side(1, "a", "u", "un").join(pairs, ["col", "a"]).join(side(-1, "b", "l", "ln").hint("merge"), ["col", "b"])

    def finish(batches):
        for batch in batches:
            out = [(c, p, selected(*x, p)) for c, own, *x in arrays(batch, "col", "places", "u", "un", "l", "ln") for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 3, (pa.string(), pa.int64(), pa.float64()))], names=["col", "place", "ratio"])

    found = {(r["col"], r["place"]): r["ratio"] for r in band.where("places is not null").mapInArrow(finish, "col string, place bigint, ratio double").collect()}  # a row a place
    if not bounds:
        return found
    band = band.where("places is null").select("col", "u", "un", "l", "ln").persist()
    while open_ := {k: v for k, v in bounds.items() if v[1] - v[0] > 1}:
        asked = {c: sorted({a + (b - a) * i // (FAN_OUT + 1) for k, (a, b) in open_.items() if k[0] == c for i in range(1, FAN_OUT + 1)} - {-1}) for c, _ in open_}

        def count(batches, asked=asked):
            for batch in batches:
                total: dict[str, list[int]] = {}
                for c, *x in arrays(batch, "col", "u", "un", "l", "ln"):
                    if c in asked:
                        own = counted(*x, [double(b) for b in asked[c]])
                        total[c] = [a + b for a, b in zip(total[c], own)] if c in total else own
                out = [(c, i, decimal.Decimal(n)) for c, own in total.items() for i, n in enumerate(own)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 3, (pa.string(), pa.int32(), pa.decimal128(38, 0)))], names=["col", "i", "n"])

        for r in band.mapInArrow(count, "col string, i int, n decimal(38,0)").groupBy("col", "i").agg(F.sum("n").alias("n")).collect():  # FAN_OUT numbers a place
            at, n = asked[r["col"]][r["i"]], int(r["n"]) + base[r["col"]]
            for (c, p), (a, b) in bounds.items():
                if c == r["col"] and a < at < b:
                    bounds[c, p] = (a, at) if n > p else (at, b)
    band.unpersist()
    return found | {k: double(b) for k, (_, b) in bounds.items()}


def medcouples(nums: DataFrame, medians: dict[str, float], total: dict[str, int]) -> dict[str, float]:
    """{col: medcouple} of (col, num, n), distinct numbers, best cached; total: the rows of each column. Computed when called."""
    if not medians:
        return {}
    parts = parts_of(nums, medians).persist()
    known = parts.select("col", "side", "slot", "low", "high", "rows").collect()  # four numbers a part
    side = lambda c, s: sum(r["rows"] for r in known if r["col"] == c and r["side"] == s)
    shape: dict[str, tuple] = {}
    places: dict[str, set[int]] = {}
    for c in medians:
        up, down = side(c, 1), side(c, -1)
        tied = total[c] - up - down
        # Of the tied ones' own pairs, as many are -1 as +1, and one for each of them is 0.
        minus, every = tied * down + tied * (tied - 1) // 2, (up + tied) * (down + tied)
        shape[c] = (up * down, tied, [k - minus for k in ((every - 1) // 2, every // 2)])
        if own := {p for k in shape[c][2] for p in (k, k - tied) if 0 <= p < up * down}:
            places[c] = own
    ratios = ratios_at(parts, known, places) if places else {}
    parts.unpersist()

    def kernel(c: str, place: int, pairs: int) -> float:
        if place < 0:
            return -1.0
        r = ratios[c, place] if place < pairs else np.inf
        return 1.0 if np.isinf(r) else (r - 1) / (r + 1)

    # The zeros of ties stand before the first kernel that is not negative.
    value = lambda c, k, pairs, tied: max(kernel(c, k - tied, pairs), min(kernel(c, k, pairs), 0.0)) if tied else kernel(c, k, pairs)
    return {c: sum(value(c, k, pairs, tied) for k in own) / 2 for c, (pairs, tied, own) in shape.items()}
