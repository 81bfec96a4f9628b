"""N-gram Jaccard join: which documents' sets of n-word shingles have Jaccard similarity >= num / den.

The join is a sparse product of the document by shingle incidence matrix with itself, taken in
blocks of columns, of which most never come about:

1. Documents with equal sets are one class. A class's columns are ordered by a global order, common
   shingles last; any two linked classes share one of their first n - ceil(t n) + 1 columns (t the
   threshold), so only those postings are shuffled.
2. Chains and pivots: in each column, classes are sorted by size and each is paired with the next, and all
   with the class that shares most columns. The pairs that a bound on the overlap (sums of minima of
   column-block counts) allows are checked, and links contract classes into components. A group of thousands of near copies becomes
   one component with a linear number of pairs.
3. The rest: in columns that still hold several components, pairs across components are candidates
   unless their sizes or that bound rule them out.
   This is exact: what is left out is either linked already or below the threshold.
4. Checking accumulates overlap counts column block by column block, for the listed pairs of a block
   of classes at a time, and discards a pair as soon as the columns left can't lift it to the threshold.

The order of columns comes from counts in hashed buckets of fixed number; it affects cost only, never the result.
Shingles are 64-bit hashes of words. Classes go by one 64-bit hash of a set, checked by a second: if two sets
share the first, all are named anew under another seed.

Edge cases: a text with fewer words than n has its whole word sequence as one shingle; null, empty or
white text has an empty set and links with nothing; repeated rows are equal classes; rows with a null id
link with nothing; an empty table gives an empty result; long texts need memory for one set of 8 bytes a
word; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, parts_for, pick, texts, tidied
from .components import components

#: Buckets of the table that says which columns are common.
BUCKETS = 1 << 24
#: A bucket is reported as common when a task has it so many times its mean, and this often at least.
COMMON_TIMES, COMMON_LEAST = 6, 3
#: Column blocks of the bound on overlaps, and classes to a block of checks.
SKETCH, BLOCK = 256, 256
#: So many class ids may be broadcast to pick the texts to read again.
BROADCAST_IDS = 1_000_000


class WordHash(dict):
    """Word -> 64-bit hash, forgetting all beyond limit words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, n: int, words: WordHash) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    if len(words) > 1_000_000:
        words.clear()
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - m + 1 + k])
    return np.unique(out)


def class_key(columns: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a = mix64(columns ^ np.uint64(0x5851F42D4C957F2D + seed)).sum(dtype=np.uint64)
    b = mix64(columns + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    both = mix64(np.array([a, b], np.uint64) + np.uint64(len(columns)))
    return tuple(both.view(np.int64).tolist())


def needed(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int):
    """The least overlap of sets of n and m that reaches the threshold: o * (den + num) >= num * (n + m)."""
    return -(-num * (n + m) // (den + num))


def common_columns(df: DataFrame, n: int) -> np.ndarray:
    """For each bucket, 0 or the size class (a logarithm) of how common its columns are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words, total = np.zeros(BUCKETS, np.uint32), WordHash(), 0
        for _, own in texts(batches):
            for text in own:
                s = shingles(text, n, words)
                np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                total += len(s)
        hot = np.flatnonzero(counts >= max(COMMON_LEAST, COMMON_TIMES * total / BUCKETS))
        yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int32()), pa.array(counts[hot].astype(np.int64))], names=["bucket", "n"])

    rows = df.mapInArrow(tidied(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(BUCKETS, np.uint8)
    for batch in rows.select("bucket", F.floor(F.log2("n")).cast("int").alias("c")).toArrow().to_batches():  # at most a row a bucket
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def prefix(columns: np.ndarray, size_class: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first columns of a set in the global order, rare ones first: one of them is shared with any linked set."""
    n = len(columns)
    take = n - -(-num * n // den) + 1 if n else 0
    order = (size_class[(columns & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (columns >> np.uint64(6))
    return columns[np.lexsort((columns, order))[:take]]


def class_rows(df: DataFrame, n: int, num: int, den: int, size_class: np.ndarray, seed: int = 0) -> DataFrame:
    """id, k1, k2, n, prefix and sketch of every row; prefix and sketch are left out where the task has given the class's already."""
    shared = df.sparkSession.sparkContext.broadcast(size_class)  # BUCKETS bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHash(), set()
        for ids, own in texts(batches):
            rows = []
            for doc, text in zip(ids, own):
                s = shingles(text, n, words)
                k1, k2 = class_key(s, seed)
                new = len(s) > 0 and doc is not None and k1 not in seen
                if new:
                    seen.add(k1)
                rows.append((doc, k1, k2, len(s), prefix(s, shared.value, num, den).view(np.int64), sketch(s)) if new else (doc, k1, k2, len(s), np.zeros(0, np.int64), None))
            c = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.binary())], names=["id", "k1", "k2", "n", "prefix", "h"])

    return df.mapInArrow(tidied(work), "id bigint, k1 bigint, k2 bigint, n bigint, prefix array<bigint>, h binary")


def sketch(columns: np.ndarray) -> bytes:
    """How many of a set's columns fall in each of SKETCH blocks, as bytes (255: that many or more)."""
    return np.minimum(np.bincount((columns >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def most_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound on overlaps from sketches (rows): sums of minima, where full bytes bound nothing."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(-1), np.int64(1) << 40, low.sum(-1, dtype=np.int64))


def shared_columns(postings: DataFrame) -> DataFrame:
    """(s, k, n, before, before_n, sig) for the columns that two or more classes share, each with the class before it by size; sig is a hash of the column's classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 3), np.int64)
        for batch in batches:
            x = np.vstack([last, np.column_stack([c.to_numpy() for c in batch.columns])])
            if not len(x):
                continue
            # The batch's last column may go on in the next batch: keep it back.
            cut = int(np.searchsorted(x[:, 0], x[-1, 0]))
            last = x[cut:]
            yield from emit(x[:cut])
        yield from emit(last)

    def emit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(x) < 2:
            return
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)  # the same class from several tasks
        x = np.ascontiguousarray(x[new])
        same = np.zeros(len(x), bool)
        same[1:] = x[1:, 0] == x[:-1, 0]
        keep = same.copy()
        keep[:-1] |= same[1:]
        first = np.flatnonzero(~same)
        mark = np.add.reduceat(mix64(x[:, 2].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first)
        sig = np.repeat(mark, np.diff(np.append(first, len(x)))).view(np.int64)
        before, size = np.roll(x[:, 2], 1), np.roll(x[:, 1], 1)
        y, own = x[keep], same[keep]
        b, bn = before[keep], size[keep]
        yield pa.RecordBatch.from_arrays([pa.array(y[:, 0]), pa.array(y[:, 2]), pa.array(y[:, 1]), pa.array(b, mask=~own), pa.array(bn, mask=~own), pa.array(sig[keep])], names=["s", "k", "n", "before", "before_n", "sig"])

    ordered = postings.repartition("s").sortWithinPartitions("s", "n", "k").select("s", "n", "k")
    return ordered.mapInArrow(work, "s bigint, k bigint, n bigint, before bigint, before_n bigint, sig bigint")


def overlap_counts(sets: list[np.ndarray], pairs: np.ndarray, num: int, den: int, block: int = 1 << 14) -> np.ndarray:
    """For each pair (i, j) of sets, whether it reaches the threshold: overlaps accumulate over blocks of columns, and pairs are discarded early."""
    sizes = np.array([len(s) for s in sets], np.int64)
    need = needed(sizes[pairs[:, 0]], sizes[pairs[:, 1]], num, den)
    alive = np.flatnonzero((need <= np.minimum(sizes[pairs[:, 0]], sizes[pairs[:, 1]])) & (sizes[pairs].min(1) > 0))
    got = np.zeros(len(pairs), np.int64)
    if not len(alive):
        return np.zeros(len(pairs), bool)
    blocks = max(1, int(sizes.sum() // block))
    # Columns are hashes, so equal ranges of them are blocks of about equal size.
    bounds = np.array([(k * (1 << 64)) // blocks for k in range(1, blocks)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]) for s in sets]
    for k in range(blocks):
        for p in alive:
            i, j = pairs[p]
            a, b = sets[i][cuts[i][k] : cuts[i][k + 1]], sets[j][cuts[j][k] : cuts[j][k + 1]]
            if len(a) and len(b):
                a, b = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                got[p] += int((b[at] == a).sum())
        left = np.array([min(len(sets[i]) - cuts[i][k + 1], len(sets[j]) - cuts[j][k + 1]) for i, j in pairs[alive]], np.int64)
        alive = alive[got[alive] + left >= need[alive]]
        if not len(alive):
            break
    return got >= need


def check_pairs(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, num: int, den: int, seed: int = 0) -> DataFrame:
    """Of pairs (a, b) of classes, those that link. Classes that pairs connect are checked together, so each text is read about once."""
    joined = components(pairs)
    sizes = joined.groupBy("component").agg(F.count("*").alias("size"))
    total = joined.count()
    blocks = parts_for(total, BLOCK)
    place = joined.join(sizes, "component").select(F.col("id").alias("a"), "component", "size")
    sub = F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / BLOCK))
    where = F.when(F.col("size") <= BLOCK, F.pmod(F.xxhash64("component"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("component", sub), F.lit(blocks)))
    placed = materialize(pairs.join(place, "a").select(where.alias("block"), "a", "b"), "placed")
    wanted = placed.select("block", F.col("a").alias("k1")).union(placed.select("block", F.col("b").alias("k1"))).distinct()
    ids = wanted.groupBy("k1").agg(F.collect_set("block").alias("blocks")).join(reps.select("k1", "rep"), "k1").select(F.col("rep").alias("id"), "k1", "blocks")
    ids = materialize(ids, "wanted")
    few = ids.count() <= BROADCAST_IDS
    # The text's own id can repeat, with another text: the class key, computed again, tells which is meant.
    rows = docs.join(F.broadcast(ids) if few else ids, "id").select("k1", "text", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            own = [shingles(t or b"", n, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            good = [class_key(s, seed)[0] == k for s, k in zip(own, keys)]
            rows = [(k, s.tobytes(), b) for k, s, b, g in zip(keys, own, batch.column(2).to_pylist(), good) if g]
            flat = [(b, k, s) for k, s, bs in rows for b in bs]
            c = list(zip(*flat)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["block", "k1", "s"])

    incidence = rows.mapInArrow(tidied(sets), "block bigint, k1 bigint, s binary")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        at: dict[int, int] = {}
        own = []
        for k, s in zip(left["k1"].to_pylist(), left["s"].to_pylist()):
            if k not in at:
                at[k] = len(own)
                own.append(np.frombuffer(s, np.uint64))
        a, b = right["a"].to_pylist(), right["b"].to_pylist()
        index = np.array([(at[x], at[y]) for x, y in zip(a, b) if x in at and y in at], np.int64).reshape(-1, 2)
        known = np.array([x in at and y in at for x, y in zip(a, b)], bool)
        linked = np.zeros(len(a), bool)
        linked[known] = overlap_counts(own, index, num, den) if len(index) else []
        return right.select(["a", "b"]).filter(pa.array(linked))

    return incidence.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(product, "a bigint, b bigint")


def cross_pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b) from (s, n, k, c, h): classes of one column in different components whose sizes and sketches allow a link."""

    def candidates(x_n, x_k, x_c, x_h) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x_n, kind="stable")
        n, k, c, h = x_n[order], x_k[order], x_c[order], x_h[order]
        out_a, out_b = [], []
        for i in range(len(n) - 1):
            end = int(np.searchsorted(n, n[i] * den // num, side="right"))
            j = np.arange(i + 1, end)
            j = j[c[j] != c[i]]
            if len(j):
                j = j[most_overlap(h[i], h[j]) >= needed(n[i], n[j], num, den)]
                out_a.append(np.full(len(j), k[i]))
                out_b.append(k[j])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            n, k, c = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
            h = np.array([np.frombuffer(r[4], np.uint8) for r in held])
            a, b = candidates(n, k, c, h)
            low, high = np.minimum(a, b), np.maximum(a, b)
            fresh = [(x, y) for x, y in zip(low.tolist(), high.tolist()) if (x, y) not in seen]
            if len(seen) < 1_000_000:
                seen.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in fresh], pa.int64()), pa.array([y for _, y in fresh], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if held and held[0][0] != row[0]:
                    yield from flush()
                    held.clear()
                held.append(row)
        yield from flush()

    ordered = groups.repartition("s").sortWithinPartitions("s", "n").select("s", "n", "k", "c", "h")
    return ordered.mapInArrow(tidied(work), "a bigint, b bigint")


def possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose sketches allow a link; marks: k1, n, h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
                n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(most_overlap(x, y) >= needed(n, m, num, den)))

    one, two = ([F.col("k1").alias(k), F.col("h").alias(f"h{k}"), F.col("n").alias(f"n{k}")] for k in "ab")
    both = pairs.join(marks.select(*one), "a").join(marks.select(*two), "b")
    return both.select("a", "b", "ha", "hb", "na", "nb").mapInArrow(work, "a bigint, b bigint")


def pivot_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): in each column, the class that shares the most columns with others, paired with every other class of a fitting size.

    The original of a family of near copies has fewest columns of its own, so it is the likeliest pivot, and links them all.
    """
    degree = shared.groupBy("k").agg(F.count("*").alias("degree"))
    rated = shared.select("s", "k", "n").join(degree, "k")
    pivots = rated.groupBy("s").agg(F.max_by(F.struct("k", "n"), F.struct("degree", "k")).alias("p"))
    both = shared.select("s", "k", "n").join(pivots, "s").select("k", "n", F.col("p.k").alias("p"), F.col("p.n").alias("m"))
    both = both.where((F.col("k") != F.col("p")) & (F.least("n", "m") * den >= F.greatest("n", "m") * num))
    return both.select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b"))


def linked_classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int]:
    """(members: id, k1, n of every row; classes: k1, component_id, lead; the seed of the keys) of (id, text).

    component_id: the smallest id of the classes that links join; lead: whether the class is its component's first, by smallest id, then key.
    """
    size_class = common_columns(docs, n)
    for seed in range(8):
        rows = materialize(class_rows(docs, n, num, den, size_class, seed), "classes")
        members = rows.select("id", "k1", "k2", "n")
        reps = materialize(members.where("n > 0 and id is not null").groupBy("k1").agg(F.min("id").alias("rep"), (F.min("k2") != F.max("k2")).alias("shared")), "reps")
        if reps.where("shared").isEmpty():
            break
    else:
        raise RuntimeError("sets share a key under every seed")
    postings = rows.select("k1", "n", F.explode("prefix").alias("s")).select("s", "n", F.col("k1").alias("k"))
    marks = materialize(rows.where("h is not null").select("k1", "n", "h").dropDuplicates(["k1"]), "sketches")
    shared = materialize(shared_columns(postings), "shared")
    # Columns with the same classes say the same: one of them is enough.
    shared = materialize(shared.join(shared.groupBy("sig").agg(F.min("s").alias("s")).select("s"), "s", "left_semi"), "columns")
    close = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    chain = shared.where(F.col("before").isNotNull() & close(F.col("n"), F.col("before_n"))).select(F.least("k", "before").alias("a"), F.greatest("k", "before").alias("b")).where("a <> b")
    chain = materialize(possible(chain.union(pivot_pairs(shared, num, den)).distinct(), marks, num, den), "chain")
    links = materialize(check_pairs(docs, reps, chain, n, num, den, seed), "links")
    linked = components(links)

    # What chains left open: columns that hold more than one component.
    here = shared.select("s", "n", "k").join(linked.select(F.col("id").alias("k"), "component"), "k", "left").select("s", "n", "k", F.coalesce("component", "k").alias("c"))
    here = materialize(here, "open")
    several = here.groupBy("s").agg((F.min("c") != F.max("c")).alias("open")).where("open").select("s")
    groups = here.join(several, "s", "left_semi").join(marks.select(F.col("k1").alias("k"), "h"), "k")
    rest = materialize(cross_pairs(groups, num, den).distinct().join(chain, ["a", "b"], "left_anti"), "rest")
    more = materialize(check_pairs(docs, reps, rest, n, num, den, seed), "links")

    # Classes are joined by their keys: two texts under one id stay two classes.
    found = components(links.unionByName(more))
    named = reps.join(found, reps["k1"] == found["id"], "left").select("k1", "rep", F.coalesce("component", "k1").alias("component"))
    first = named.groupBy("component").agg(F.min(F.struct("rep", "k1")).alias("first"))
    classes = named.join(first, "component").select("k1", F.col("first.rep").alias("component_id"), (F.col("first.k1") == F.col("k1")).alias("lead"))
    return members, classes, seed


def jaccard_join(df: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id: a row for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = pick(df, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    members, classes, _ = linked_classes(docs, n, num, den)
    out = members.join(classes, "k1", "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(own, F.col("id")).cast(kind).alias("component_id"))


def drop_near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that stay: of each component the row with the smallest id; of rows that repeat an id and a text one.

    It is decided by row, not by id: another text under an id of a copy stays if it is no copy itself. Rows with a null id
    and texts without words link with nothing and stay.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = pick(df, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    members, classes, seed = linked_classes(docs, n, num, den)
    of = members.where("id is not null").join(classes, "k1", "left")
    decided = of.groupBy("id", "k1").agg(F.count("*").alias("rows"), F.first(F.coalesce((F.col("n") == 0) | F.col("lead") & (F.col("id") == F.col("component_id")), F.lit(True))).alias("stays"))
    by_id = materialize(decided.groupBy("id").agg(F.sum("rows").alias("rows"), F.bool_and("stays").alias("stays")).where("rows > 1 or not stays"), "decided")
    table = by_id.select(F.col("id").cast(kind).alias(id_col), (F.col("rows") > 1).alias("datassay_again"))
    few = by_id.count() <= BROADCAST_IDS
    table = F.broadcast(table) if few else table
    stays = df.join(table, id_col, "left_anti").select(*df.columns)
    again = by_id.where("rows > 1").select(F.col("id").cast(kind).alias(id_col))
    if again.isEmpty():
        return stays
    # Ids that occur on several rows: their texts' classes are computed again.
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for names, own in texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([class_key(shingles(t, n, words), seed)[0] for t in own], pa.int64()), pa.array([t.decode() for t in own])], names=["id", "k1", "text"])

    rows = df.join(F.broadcast(again) if few else again, id_col, "left_semi").select(*df.columns).dropDuplicates([id_col, text_col])
    repeated = materialize(docs.join(by_id.where("rows > 1").select("id"), "id", "left_semi").mapInArrow(keyed, "id bigint, k1 bigint, text string").dropDuplicates(["id", "text"]), "repeated")
    # Of rows of one id and one set (texts may differ in spaces and case) the first text stays.
    good = repeated.join(decided.where("stays").select("id", "k1"), ["id", "k1"]).groupBy("id", "k1").agg(F.min("text").alias("t")).select(F.col("id").cast(kind).alias("datassay_i"), F.col("t").alias("datassay_t"))
    several = rows.join(good, (rows[id_col] == good["datassay_i"]) & (F.coalesce(rows[text_col], F.lit("")) == good["datassay_t"])).select(*df.columns)
    return stays.unionByName(several.dropDuplicates([id_col, text_col]))
