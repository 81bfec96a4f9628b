"""Phrase collocations: n-gram counts from suffix arrays of shards, merged by key, and phrases scored by their weakest cut.

A text is lower-cased (A-Z), cut at punctuation and line ends into pieces, and those at spaces and tabs into words. All is
per language. A candidate is a phrase of 2 to `longest` words that occurs `least` times; cutting it after k words gives
l = f(first part), r = f(rest) and a score of a * a / (l * r); its lowest cut counts. A candidate inside a longer one that
occurs `share` of its times is dropped; the rest are ranked.

1. Words are 64-bit hashes that hold the language. A shard of about SHARD_WORDS words becomes word ids in one sequence,
   whose suffix array comes by prefix doubling; LCP intervals of depth k are its distinct phrases of k words with counts.
2. Counts are merged by the words' hashes, level by level. A level's frequent phrases are a table of bits, of fixed size, by
   which the shards of the next level leave out places that can't begin a frequent phrase. Bits that are set without cause
   cost rows, never change a count.
3. Cuts, containment and words are joins of the tables of frequent phrases by those hashes. Should two words share a hash,
   all is done again with another seed, so counts are exact. Scores are exact decimals.
4. Ranks go by parts of a language first, of which each passes on `top` rows.

Edge cases: null and empty texts have no words; a null language counts as `und`; repeated rows count as often as they
occur; ids are not read, so null ones count; texts of any length are read whole, in memory of some 60 bytes a byte of the longest; an empty table gives an
empty result; other columns, whatever they are called, are not read. Counts up to 10**15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_shuffles, materialize, mix64, pick, tidied
from .suffixes import intervals, shared_words, suffix_array, to_stop
from .wordcodes import flags, hashes, pieces, spans

SHARD_WORDS = 600_000
#: Bits of the table of frequent phrases, and of one of the ranges by which it is made.
BITS, RANGE_BITS = 26, 18
BREAK = flags(b".,;:!?\n\x0b\x0c\r")
BLANK = BREAK | flags(b" \t")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Parts of a language that are ranked by themselves first.
PARTS = 64


def bit_of(words: list[np.ndarray]) -> np.ndarray:
    """The bit that stands for each phrase."""
    k = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return (k >> np.uint64(64 - BITS)).astype(np.int64)


class Marked:
    """Which phrases may be frequent, by a packed table of bits."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __call__(self, words: list[np.ndarray]) -> np.ndarray:
        at = bit_of(words)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def marks(frequent: DataFrame, n: int) -> np.ndarray:
    """The packed table of bits of phrases w1..wn: made by ranges in tasks, so that 2**BITS / 8 bytes reach the driver at any size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(bit_of([c.to_numpy() for c in batch.columns]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> RANGE_BITS), pa.array(at & ((1 << RANGE_BITS) - 1))], names=["part", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << RANGE_BITS, bool)
        own[table["bit"].to_numpy()] = True
        return pa.table({"part": table["part"][:1], "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    rows = frequent.select(*[f"w{i + 1}" for i in range(n)]).mapInArrow(bits, "part bigint, bit bigint").distinct()
    out = np.zeros((1 << (BITS - RANGE_BITS), 1 << (RANGE_BITS - 3)), np.uint8)
    for row in rows.groupBy("part").applyInArrow(pack, "part bigint, data binary").collect():  # a row a range
        out[row["part"]] = np.frombuffer(row["data"], np.uint8)
    return out.reshape(-1)


class Shard:
    """Words of whole texts, by hash, until there are enough of them for a suffix array."""

    def __init__(self, seed: int, keep_words: bool):
        self.seed, self.keep_words, self.langs = seed, keep_words, {}
        self.clear()

    def clear(self) -> None:
        self.size, self.hashes, self.fresh, self.words, self.seen = 0, [], [], [], np.zeros(0, np.uint64)

    def add(self, langs: list, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, text = spans(data, offsets, BLANK)
        seeds = np.array([self.langs.get(x) or self.langs.setdefault(x, xxhash.xxh3_64_intdigest(x.encode(), self.seed) or 1) for x in langs], np.uint64)
        h = mix64(hashes(data, starts, ends) ^ seeds[text])
        piece = np.cumsum(BREAK[data])[starts] if len(starts) else starts
        fresh = np.ones(len(h), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        if self.keep_words and len(h):
            # The texts of words that are new here: first places of hashes that no piece before has.
            own, first = np.unique(h, return_index=True)
            new = ~np.isin(own, self.seen, assume_unique=True)
            first, self.seen = first[new], np.concatenate([self.seen, own[new]])
            raw = data.tobytes()
            self.words.append((h[first], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], [langs[t] for t in text[first].tolist()]))
        self.hashes.append(h)
        self.fresh.append(fresh)
        self.size += len(h)

    def counted(self, n: int, marked: list) -> tuple[list[np.ndarray], np.ndarray]:
        """(w1..wn, counts): distinct phrases of n words; marked: the tables of 1 to n - 1 words, of which the longest and the first are asked."""
        h, fresh = np.concatenate(self.hashes), np.concatenate(self.fresh)
        if n > 1:
            at = np.flatnonzero(marked[0]([h]))
            gap = np.diff(at, prepend=-2) > 1
            h, fresh = h[at], fresh[at] | gap
        m = n - 1
        if m > 1 and len(h) >= m:
            whole = np.ones(len(h) - m + 1, bool)
            for k in range(1, m):
                whole &= ~fresh[k : len(whole) + k]
            at = np.flatnonzero(whole)
            held = np.zeros(len(h), bool)
            held[at[marked[m - 1]([h[at + k] for k in range(m)])]] = True
            # A word goes on from the one before where a frequent phrase of m words holds both; words in none are left out.
            goes_on = np.zeros(len(h), bool)
            for k in range(1, m):
                goes_on[k:] |= held[:-k]
            use = held | goes_on
            h, fresh = h[use], ~goes_on[use]
        if not len(h):
            return [np.zeros(0, np.int64)] * n, np.zeros(0, np.int64)
        known, number = np.unique(h, return_inverse=True)
        place = np.arange(len(h)) + np.cumsum(fresh) - 1  # the first one is fresh
        ids = np.zeros(int(place[-1]) + 2, np.int64)
        ids[place] = number + 1
        order, left = suffix_array(ids, n), to_stop(ids)
        first, times = intervals(ids, order, shared_words(ids, order, n), n, left)
        return [known[ids[first + k] - 1].view(np.int64) for k in range(n)], times


def shards(docs: DataFrame, seed: int, keep_words: bool, emit, schema: str, shard_words: int) -> DataFrame:
    """emit(shard) of every shard of (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(seed, keep_words)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, data, offsets in pieces(batch.column(1)):
                shard.add(langs[at : at + len(offsets) - 1], data, offsets)
                if shard.size >= shard_words:
                    yield from emit(shard)
                    shard.clear()
        if shard.size:
            yield from emit(shard)

    return docs.mapInArrow(tidied(work), schema)


def word_counts(docs: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """(w1, lang, word, a) of every word."""

    def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
        (own,), times = shard.counted(1, [])
        h = np.concatenate([x[0] for x in shard.words])
        words, langs = sum((x[1] for x in shard.words), []), sum((x[2] for x in shard.words), [])
        at, place = np.unique(h, return_index=True)
        place = place[np.searchsorted(at, own.view(np.uint64))].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([langs[i] for i in place]), pa.array([words[i] for i in place], pa.binary()).cast(pa.string()), pa.array(times)], names=["w1", "lang", "word", "a"])

    rows = shards(docs, seed, True, emit, "w1 bigint, lang string, word string, a bigint", shard_words)
    return materialize(rows.groupBy("w1", "lang", "word").agg(F.sum("a").alias("a")), "words")


def phrase_counts(docs: DataFrame, n: int, seed: int, tables: list[np.ndarray], least: int, shard_words: int) -> DataFrame:
    """(w1..wn, a) of the phrases of n words that occur `least` times; tables: the marks of 1 to n - 1 words."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # 2**BITS / 8 bytes each
    names = [f"w{i + 1}" for i in range(n)]

    def emit(shard: Shard) -> Iterator[pa.RecordBatch]:
        words, times = shard.counted(n, [Marked(t) for t in shared.value])
        yield pa.RecordBatch.from_arrays([*(pa.array(w) for w in words), pa.array(times)], names=[*names, "a"])

    rows = shards(docs, seed, False, emit, ", ".join(f"{c} bigint" for c in (*names, "a")), shard_words)
    return materialize(rows.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least), f"phrases{n}")


def part_of(table: DataFrame, n: int, at: int, name: str) -> DataFrame:
    """A table of phrases of n words, to be joined to the words at..at+n-1 of longer ones."""
    return table.select(*[F.col(f"w{i + 1}").alias(f"w{at + i}") for i in range(n)], F.col("a").alias(name))


def cuts(levels: list[DataFrame], n: int) -> DataFrame:
    """(w1..wn, a, l, r, score) of the phrases of n words by their lowest cut, the first of equal ones."""
    out, found = levels[n - 1], []
    for k in range(1, n):
        out = out.join(part_of(levels[k - 1], k, 1, "l_"), [f"w{i + 1}" for i in range(k)])
        out = out.join(part_of(levels[n - k - 1], n - k, k + 1, "r_"), [f"w{i + 1}" for i in range(k, n)])
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        top, under = F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l_") * wide("r_")
        out = out.withColumn("t_", top).withColumn("u_", under).withColumn(f"cut{k}", F.struct(F.expr("t_ div u_").alias("score"), F.lit(k).alias("k"), F.col("l_").alias("l"), F.col("r_").alias("r"))).drop("l_", "r_", "t_", "u_")
        found.append(f"cut{k}")
    low = F.least(*found) if len(found) > 1 else F.col(found[0])
    return out.withColumn("low", low).select(*[f"w{i + 1}" for i in range(n)], "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))


def collocations(df: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: tuple[int, int] = (50, 100), text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language. share: (num, den) of the rule on longer candidates."""
    spark = df.sparkSession
    docs = pick(df, text_col, lang_col).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    for seed in range(8):
        words = word_counts(docs, seed, shard_words)
        if words.groupBy("w1").count().where("count > 1").isEmpty():
            break
        discard(words)
    else:
        raise RuntimeError("words share a hash under every seed")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [words.where(F.col("a") >= least).select("w1", "a")]
    tables: list[np.ndarray] = []
    for n in range(2, longest + 1):
        tables.append(marks(levels[-1], n - 1))
        levels.append(phrase_counts(docs, n, seed, tables, least, shard_words))
        free_shuffles(spark)
    text = words.where(F.col("a") >= least)
    ranked = None
    for n in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(n)]
        own = cuts(levels, n)
        inside = None
        for m in range(n + 1, longest + 1):
            subs = F.explode(F.array(*[F.struct(*[F.col(f"w{at + i}").alias(f"w{i + 1}") for i in range(n)]) for at in range(1, m - n + 2)]))
            longer = levels[m - 1].select(subs.alias("s"), "a").select("s.*", "a")
            inside = longer if inside is None else inside.unionByName(longer)
        if inside is not None:
            most = inside.groupBy(*names).agg(F.max("a").alias("most"))
            own = own.join(most, names, "left").where(F.col("most").isNull() | (F.col("most") * share[1] < F.col("a") * share[0])).drop("most")
        for i in range(n):
            own = own.join(text.select(F.col("w1").alias(f"w{i + 1}"), F.col("word").alias(f"t{i + 1}"), *([F.col("lang")] if i == 0 else [])), f"w{i + 1}")
        own = own.select("lang", F.concat_ws(" ", *[f"t{i + 1}" for i in range(n)]).alias("phrase"), "a", "l", "r", "score")
        ranked = own if ranked is None else ranked.unionByName(own)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
