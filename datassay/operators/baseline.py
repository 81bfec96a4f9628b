"""The cross-validated baseline from mergeable sums: one pass over the rows for all folds, and for every column alone.

A row's design is the same for all folds: a number and whether it is missing, one column a level that any fold keeps. What a fold
learns (fills, means, scales, its own levels and bins) is a linear map of that design, so its Gram matrix follows from sums
over the base design, and a training set's from all rows less the fold's own. A column alone is a table of cells (fine bins or levels) by fold and class.
Class predictions need one more pass, for all folds at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import as_number, family, is_missing, level_key, native, to_cell
from ..functions.order import select_places, sizes
from .prep import solve

MAX_LEVELS, QUANTILE_BINS = 20, 20
REST = "(infrequent)"


@dataclass
class Number:
    """What each fold's training rows say of a number column: {fold: (fill, mean, scale, edges)}; shift: taken off before sums."""

    shift: float
    folds: dict[int, tuple[float, float, float, np.ndarray]]

    @property
    def edges(self) -> np.ndarray:
        """All folds' edges: cells between them are parts of every fold's bins."""
        return np.unique(np.concatenate([e for *_, e in self.folds.values()])) if self.folds else np.zeros(0)


@dataclass
class Fitted:
    numbers: dict[str, Number]
    levels: dict[str, dict[int, list[str]]]  # column -> fold -> levels by frequency, the first one fills
    presence: list[str]
    flags: set[str]
    folds: int
    binned: bool

    def named(self, c: str) -> list[str]:
        """The levels of a column that some fold keeps."""
        return sorted({k for own in self.levels[c].values() for k in kept(own)[0]})


def kept(levels: list[str]) -> tuple[list[str], bool]:
    """(levels with a column of their own, whether the rest has one)."""
    return (levels, False) if len(levels) <= MAX_LEVELS else (levels[: MAX_LEVELS - 1], True)


def fit_folds(df: DataFrame, numeric: dict[str, tuple[str, bool]], categorical: dict[str, bool], presence: list[str], folds: int, binned: bool) -> Fitted:
    """The fits of every training set, all but one fold: number columns from one table of values by fold, levels from one of levels by fold."""
    numbers: dict[str, Number] = {}
    if numeric:
        each = F.array(*[F.struct(F.lit(c).alias("col"), as_number(df, c).alias("num")) for c in numeric])
        values = df.select("fold", F.explode(each).alias("e")).select("fold", "e.*").where("num is not null")
        own = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(folds)]
        by_value = values.groupBy("col", "num", "fold").agg(F.count("*").alias("n")).groupBy("col", "num").agg(F.sum("n").alias("all"), *own).persist()
        others = F.explode(F.array(*[F.struct(F.lit(f"#{f}").alias("f"), (F.col("all") - F.col(f"n{f}")).alias("n")) for f in range(folds)])).alias("t")
        train = by_value.select("col", "num", others).select(F.concat("col", "t.f").alias("col"), "num", F.col("t.n").alias("n")).where("n > 0")
        known = sizes(train)
        x, n = F.col("num"), F.col("n")
        base = {r["col"]: r["m"] for r in by_value.groupBy("col").agg((F.sum(x * F.col("all")) / F.sum("all")).alias("m")).collect()}
        shift = F.coalesce(F.element_at(F.create_map(*[v for c, m in base.items() for v in (F.lit(c), F.lit(m))]), F.regexp_extract("col", r"^(.*)#\d+$", 1)), F.lit(0.0)) if base else F.lit(0.0)
        sums = {r["col"]: r for r in train.withColumn("d", x - shift).groupBy("col").agg(F.sum("n").alias("n"), F.sum(F.col("d") * n).alias("s"), F.sum(F.col("d") * F.col("d") * n).alias("q"), F.max(F.struct("n", -x)).alias("mode")).collect()}
        places: dict[str, dict[str, int]] = {}
        for at, (_, m) in known.items():
            c = at.rpartition("#")[0]
            own_places = {"m<": (m - 1) // 2, "m>": m // 2} if numeric[c][0] == "median" else {}
            places[at] = own_places | ({f"e{j}": j * m // QUANTILE_BINS for j in range(1, QUANTILE_BINS)} if binned else {})
        found = select_places(train, places, known)
        by_value.unpersist()
        rows = {r["fold"]: r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        for c, (how, _) in numeric.items():
            mine: dict[int, tuple[float, float, float, np.ndarray]] = {}
            for f in range(folds):
                s = sums.get(f"{c}#{f}")
                if s is None:
                    continue
                p = found.get(f"{c}#{f}", {})
                total, m, mean = sum(rows.values()) - rows.get(f, 0), s["n"], s["s"] / s["n"]
                fill = {"median": lambda: (p["m<"] + p["m>"]) / 2 - base[c], "mean": lambda: mean, "most_frequent": lambda: -s["mode"][1] - base[c]}[how]()  # noqa: B023
                middle = (s["s"] + (total - m) * fill) / total
                spread = s["q"] - 2 * middle * s["s"] + m * middle**2 + (total - m) * (fill - middle) ** 2
                scale = np.sqrt(max(spread, 0.0) / total)
                mine[f] = (fill + base[c], middle + base[c], float(scale) if scale > 1e-12 * max(1.0, abs(middle + base[c])) else 1.0, np.unique([p[k] for k in p if k.startswith("e")]))
            if mine:
                numbers[c] = Number(base[c], mine)
    levels: dict[str, dict[int, list[str]]] = {}
    if categorical:
        own = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(folds)]
        counts: DataFrame | None = None
        for kind in ("double", "bigint", "timestamp", "string"):
            of = [c for c in categorical if family(df, c) == kind]
            if of:
                # Native values are counted first, so a level's text is made once a value and fold.
                each = F.array(*[F.struct(F.lit(c).alias("col"), native(df, c).alias("v")) for c in of])
                seen = df.select("fold", F.explode(each).alias("e")).select("fold", "e.*").groupBy("col", "v", "fold").agg(F.count("*").alias("n"))
                part = seen.select("col", level_key(seen, "v").alias("k"), "fold", "n")
                counts = part if counts is None else counts.unionByName(part)
        counts = counts.where("k is not null").groupBy("col", "k").agg(F.sum("n").alias("all"), *own)
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), (F.col("all") - F.col(f"n{f}")).alias("n")) for f in range(folds)])).alias("t")
        ranked = counts.select("col", "k", each).select("col", "k", "t.*").where("n > 0").withColumn("i", F.row_number().over(Window.partitionBy("col", "f").orderBy(F.desc("n"), "k"))).where(F.col("i") <= MAX_LEVELS + 1)
        for r in sorted(ranked.collect(), key=lambda r: (r["col"], r["f"], r["i"])):  # at most MAX_LEVELS + 1 a column and fold
            levels.setdefault(r["col"], {}).setdefault(r["f"], []).append(r["k"])
    flags = {c for c, (_, flag) in numeric.items() if flag} | {c for c, flag in categorical.items() if flag}
    return Fitted(numbers, levels, list(presence), flags, folds, binned)


class Design:
    """The base design: where each column's parts are, and how rows become matrices."""

    def __init__(self, fit: Fitted):
        self.fit, self.at, width = fit, {}, 1
        for c in fit.numbers:
            self.at[c], width = width, width + 2  # value, missing
        for c in fit.levels:
            self.at[c], width = width, width + len(fit.named(c)) + 1
        for c in fit.presence:
            self.at[c], width = width, width + 1
        self.width = width
        self.columns = [*fit.numbers, *fit.levels, *fit.presence]

    def project(self, df: DataFrame) -> list:
        """Columns of df that read() takes, in the order of `columns`: numbers, levels' keys, 0 or 1 for missing."""
        out = [as_number(df, c).alias(f"c{i}") for i, c in enumerate(self.fit.numbers)]
        for c in self.fit.levels:
            out.append(level_key(df, c).alias(f"c{len(out)}"))
        for c in self.fit.presence:
            out.append(is_missing(to_cell(df, c)).cast("int").alias(f"c{len(out)}"))
        return out

    def read(self, columns: list[pa.Array]) -> list[np.ndarray]:
        """Numbers (NaN: missing), places of levels (-2: another level, -1: missing), 0 or 1."""
        out = []
        for c, x in zip(self.columns, columns):
            if c in self.fit.levels:
                place, d = {k: i for i, k in enumerate(self.fit.named(c))}, x.dictionary_encode()
                at = np.array([*(place.get(k, -2) for k in d.dictionary.to_pylist()), -1])
                out.append(at[d.indices.fill_null(len(at) - 1).to_numpy().astype(np.int64)])
            else:
                out.append(x.to_numpy(zero_copy_only=False))
        return out

    def rows(self, columns: list[np.ndarray]) -> np.ndarray:
        n = len(columns[0]) if columns else 0
        b = np.zeros((n, self.width))
        b[:, 0] = 1.0
        for c, x in zip(self.columns, columns):
            at = self.at[c]
            if c in self.fit.numbers:
                gone = np.isnan(x)
                b[:, at], b[:, at + 1] = np.where(gone, 0.0, x - self.fit.numbers[c].shift), gone
            elif c in self.fit.levels:
                last = at + len(self.fit.named(c))
                own = np.flatnonzero(x >= 0)
                b[own, at + x[own]] = 1.0
                b[:, last] = x == -1
            else:
                b[:, at] = x
        return b

    def cells(self, i: int, x: np.ndarray) -> np.ndarray:
        """A column's cell of each row, from 0: missing, the rest, then fine bins or levels."""
        c = self.columns[i]
        if c in self.fit.numbers:
            return np.where(np.isnan(x), 0, np.searchsorted(self.fit.numbers[c].edges, x, side="right") + 2)
        return np.where(x >= 0, x + 2, -1 - x) if c in self.fit.levels else np.where(x == 1, 0, 2)

    def cells_of(self, c: str) -> int:
        """How many cells a column has."""
        if c in self.fit.numbers:
            return len(self.fit.numbers[c].edges) + 3
        return len(self.fit.named(c)) + 2 if c in self.fit.levels else 3

    def fold_map(self, f: int) -> np.ndarray:
        """The linear map from the base design to [1, what fold f's training set makes of the columns]."""
        cols = [np.eye(self.width)[0]]
        for c, own in self.fit.numbers.items():
            if f in own.folds:
                fill, mean, scale, _ = own.folds[f]
                x = np.zeros(self.width)
                x[0], x[self.at[c]], x[self.at[c] + 1] = (own.shift - mean) / scale, 1 / scale, (fill - own.shift) / scale
                cols.append(x)
                if c in self.fit.flags:
                    cols.append(np.eye(self.width)[self.at[c] + 1])
        for c, by_fold in self.fit.levels.items():
            if f in by_fold:
                names, gone = self.fit.named(c), self.at[c] + len(self.fit.named(c))
                own, rest = kept(by_fold[f])
                for k in own:
                    x = np.zeros(self.width)
                    x[self.at[c] + names.index(k)] = 1.0
                    x[gone] = float(k == own[0])
                    cols.append(x)
                if rest:
                    x = np.zeros(self.width)
                    x[0], x[gone] = 1.0, -1.0
                    x[[self.at[c] + names.index(k) for k in own]] = -1.0
                    cols.append(x)
                if c in self.fit.flags:
                    cols.append(np.eye(self.width)[gone])
        cols += [np.eye(self.width)[self.at[c]] for c in self.fit.presence]
        return np.array(cols).T

    def alone(self, c: str, f: int, cells: int) -> np.ndarray | None:
        """[1, features of the column alone] of each of its cells in fold f's training set; null where it has nothing to learn from."""
        x = [np.ones(cells)]
        if c in self.fit.numbers:
            if f not in self.fit.numbers[c].folds:
                return None
            every, own = self.fit.numbers[c].edges, self.fit.numbers[c].folds[f][3]
            lower = np.concatenate([[-np.inf], every])[: cells - 2]
            bin_ = np.searchsorted(own, lower, side="right")
            x += [np.concatenate([[0, 0], bin_ == j]) for j in range(len(own) + 1)]
            x.append(np.eye(cells)[0])
        elif c in self.fit.levels:
            if f not in self.fit.levels[c]:
                return None
            names = self.fit.named(c)
            own, rest = kept(self.fit.levels[c][f])
            shown = [np.concatenate([[float(k == own[0]), 0], [float(k == m) for m in names]]) for k in own]
            x += shown
            if rest:
                x.append(1.0 - np.sum(shown, axis=0))
            if c in self.fit.flags:
                x.append(np.eye(cells)[0])
        else:
            x.append(np.eye(cells)[0])
        return np.array(x, float).T


def summed(parts: DataFrame) -> dict[tuple[int, int, int], np.ndarray]:
    """{(kind, f, i): v} of rows (kind, f, i, v), vectors of a key added; few keys."""

    def add(table: pa.Table) -> pa.Table:
        v = np.sum([np.array(x) for x in table["v"].to_pylist()], axis=0)
        return pa.table({"kind": table["kind"][:1], "f": table["f"][:1], "i": table["i"][:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    rows = parts.groupBy("kind", "f", "i").applyInArrow(add, "kind int, f int, i int, v array<double>").collect()
    return {(r["kind"], r["f"], r["i"]): np.array(r["v"]) for r in rows}


def emitted(held: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
    c = list(zip(*held)) or [[]] * 3
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in c), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["kind", "f", "i", "v"])


#: Folds times classes of which a task holds a Gram matrix each.
SPLIT_GRAMS = 64
SUMS = "kind int, f int, i int, v array<double>"


def cross_validate(df: DataFrame, fit: Fitted, classes: int | None, alpha: float = 1.0, per_column: bool = True, whole: bool = True) -> tuple[list[tuple[float, float]], dict[str, list[tuple[float, float]]]]:
    """((model, baseline) by fold, the same of each column alone): balanced accuracy, one against the rest with balanced weights; R2 for numbers (classes null).

    df: rows with fold and datassay_y, a number or a class's place. whole: whether the model of all columns is asked for; its scores are none where not.
    """
    folds, design = fit.folds, Design(fit)
    k = classes or 0
    # A Gram matrix a fold and class, where these are few: training sets are their weighted sums. Else one a training set.
    split = 0 < k * folds <= SPLIT_GRAMS
    sizes_ = np.zeros((folds, max(k, 1)))
    moments = df.groupBy("fold", *(["datassay_y"] if k else [])).agg(F.count("*").alias("n"), F.sum("datassay_y").alias("s")).collect()
    for r in moments:
        sizes_[r["fold"], int(r["datassay_y"]) if k else 0] += r["n"]
    middle = sum(r["s"] for r in moments) / max(1.0, sizes_.sum()) if not k and moments else 0.0
    train = sizes_.sum(0) - sizes_
    weights = np.ones((folds, max(k, 1)))
    if k:
        there = train > 0
        weights = np.where(there, train.sum(1, keepdims=True) / (np.maximum(there.sum(1, keepdims=True), 1) * np.maximum(train, 1)), 0.0)
    rows = df.select(F.col("fold").cast("int").alias("fold"), F.col("datassay_y").cast("double").alias("y"), *design.project(df))

    def read(batch):
        fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return fold, y, design.read(batch.columns[2:])

    tall_ = [design.cells_of(c) for c in design.columns]

    def collect(batches):
        held: dict[tuple[int, int, int], np.ndarray] = {}
        alone_: dict[int, np.ndarray] = {}

        def add(kind, f, matrix):
            for i, v in enumerate(matrix):
                at = (kind, int(f), i)
                held[at] = held[at] + v if at in held else v.copy()

        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y, columns = read(batch)
            at = fold * k + y.astype(np.int64) if k else fold
            b = design.rows(columns) if whole else None
            if whole and split:
                for g in np.unique(at):
                    add(0, g, b[at == g].T @ b[at == g])
            elif whole and k:
                goal = np.eye(k)[y.astype(int)]
                for f in range(folds):
                    own = fold != f
                    weighted = b[own] * weights[f][y[own].astype(int)][:, None]
                    add(0, f, weighted.T @ np.hstack([b[own], goal[own]]))
            elif whole:
                full = np.hstack([b, (y - middle)[:, None]])
                for f in range(folds):
                    add(0, f, full[fold == f].T @ full[fold == f])
            if per_column:
                for j, x in enumerate(columns):
                    cell = design.cells(j, x).astype(np.int64)
                    if k:
                        found = np.bincount((cell * folds + fold) * k + y.astype(np.int64), minlength=tall_[j] * folds * k).reshape(-1, k).astype(float)
                    else:
                        found = np.column_stack([np.bincount(cell * folds + fold, v, minlength=tall_[j] * folds) for v in (np.ones(len(y)), y - middle, (y - middle) ** 2)])
                    alone_[j] = alone_[j] + found if j in alone_ else found
        for j, found in alone_.items():
            for place in np.flatnonzero(found.any(1)):
                held[1 + j, int(place % folds), int(place // folds)] = found[place]
        yield emitted(held)

    total = summed(rows.mapInArrow(collect, SUMS))
    width = design.width
    outs = k or 1
    tall = width if k else width + 1
    if split:
        own = {g: np.array([total.get((0, g, i), np.zeros(width)) for i in range(width)]) for g in range(folds * k)} if whole else {}
        gram = {}
        for f in range(folds) if whole else ():
            by = [weights[f][c] * sum(own[g * k + c] for g in range(folds) if g != f) for c in range(k)]
            gram[f] = np.hstack([sum(by), np.column_stack([m[:, 0] for m in by])])
    else:
        gram = {f: np.array([total.get((0, f, i), np.zeros(width + outs)) for i in range(tall)]) for f in range(folds)}
    scores: list[tuple[float, float]] = []
    used = [f for f in range(folds) if sizes_[f].sum() and train[f].sum()]

    def betas(m: np.ndarray, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Ridge weights by class, from the weighted Gram of [1, features] and the sums by class; for two classes those of the second."""
        out = []
        for c in [1] if k == 2 else range(k):
            target = 2 * sums[:, c] - sums.sum(1)
            one = np.block([[x, target[:, None]], [target[None], np.array([[x[0, 0]]])]])
            out.append(solve(one, alpha))
        return np.array(out).T

    def majority(f: int) -> float:
        seen = [c for c in range(k) if sizes_[f, c]]
        return (1.0 if int(np.argmax(train[f])) in seen else 0.0) / len(seen)

    if not whole:
        pass
    elif k:
        gamma = {}
        for f in used:
            t = design.fold_map(f)
            gamma[f] = t @ betas(gram[f], t.T @ gram[f][:, :width] @ t, t.T @ gram[f][:, width:])

        def hits(batches):
            held: dict[tuple[int, int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold, y, columns = read(batch)
                b = design.rows(columns)
                for f in used:
                    own = fold == f
                    s = b[own] @ gamma[f]
                    said = (s[:, 0] > 0).astype(int) if k == 2 else s.argmax(1)
                    right = np.bincount(y[own].astype(int)[said == y[own]], minlength=k).astype(float)
                    held[0, f, 0] = held.get((0, f, 0), 0) + right
            yield emitted(held)

        right = summed(rows.mapInArrow(hits, SUMS))
        for f in used:
            seen = [c for c in range(k) if sizes_[f, c]]
            scores.append((float(np.mean([right[0, f, 0][c] / sizes_[f, c] for c in seen])), majority(f)))
    else:
        every = sum(gram.values())
        for f in used:
            t = np.zeros((width + 1, 0))
            m = design.fold_map(f)
            t = np.block([[m, np.zeros((width, 1))], [np.zeros((1, m.shape[1])), np.ones((1, 1))]])
            rest, own = t.T @ (every - gram[f]) @ t, t.T @ gram[f] @ t
            scores.append(errors(np.append(solve(rest, alpha), -1.0), own, rest))
    alone: dict[str, list[tuple[float, float]]] = {}
    for j, c in enumerate(design.columns if per_column else []):
        found = {(f, i): v for (kind, f, i), v in total.items() if kind == 1 + j}
        cells = tall_[j]
        stats = np.zeros((folds, cells, k or 3))
        for (f, i), v in found.items():
            stats[f, i] = v
        own_scores = []
        for f in used:
            x = design.alone(c, f, cells)
            if x is None:
                continue
            rest = stats.sum(0) - stats[f]
            if k:
                w = rest * weights[f]
                beta = betas(w, x.T @ (x * w.sum(1)[:, None]), x.T @ w)
                s = x @ beta
                said = (s[:, 0] > 0).astype(int) if k == 2 else s.argmax(1)
                right_ = stats[f] * (said[:, None] == np.arange(k))
                seen = [i for i in range(k) if sizes_[f, i]]
                own_scores.append((float(np.mean([right_[:, i].sum() / sizes_[f, i] for i in seen])), majority(f)))
            else:
                both = []
                for s in (rest, stats[f]):
                    xx = x.T @ (x * s[:, :1])
                    xy = x.T @ s[:, 1]
                    both.append(np.block([[xx, xy[:, None]], [xy[None], np.array([[s[:, 2].sum()]])]]))
                own_scores.append(errors(np.append(solve(both[0], alpha), -1.0), both[1], both[0]))
        if own_scores:
            alone[c] = own_scores
    return scores, alone


def errors(b: np.ndarray, own: np.ndarray, rest: np.ndarray) -> tuple[float, float]:
    """(R2 of the model, R2 of the training mean) on the rows of a Gram matrix [1, features, y]."""
    n, mean = own[0, 0], own[0, -1] / own[0, 0]
    spread = own[-1, -1] - n * mean**2
    if spread <= 1e-12 * max(own[-1, -1], 1e-300):
        return 0.0, 0.0
    off = mean - rest[0, -1] / rest[0, 0]
    return float(1 - b @ own @ b / spread), float(1 - (spread + n * off**2) / spread)
