"""Katz backoff language model of order 3 over whole words: Good-Turing discounted counts, exactly normalised backoff weights.

Tokens are a text's words (A-Z lowered) and one end; every word is a symbol of its own, however rare.

    P(w | u, v) = d3[r] * r / (C(u, v) + 1)   if (u, v, w) was seen r > 0 times, else alpha(u, v) * P(w | v)
    P(w | v)    = d2[r] * r / (C(v) + 1)      if (v, w) was seen r > 0 times, else alpha(v) * P(w)
    P(w)        = (c(w) + 1) / (N + V + 1);   an unknown word has c = 0

A text's first word has only the start before it, so it is scored by P(w | start). d is the Good-Turing discount for
r <= K and 1 above; alpha spreads what the discounts and the one reserved event of each context leave over the words not
seen after it, so the words after any context, with one unknown word, sum to one exactly.

1. Documents become blocks of about BLOCK_TOKENS tokens, written as a table: word numbers and the words' hashes.
2. A block sends each of its distinct n-grams (64-bit hashes, all orders), counted over its training texts, once to the part
   that owns the hash's range, in ROUNDS rounds. Parts sum, and answer each block in the order of its question; the answers are the count
   tables, by part and block. A frequent n-gram costs a part one entry a block, so no key is hot.
3. A block scores what was seen, and sends sums of its contexts' seen words: an n-gram counts at the first block that
   has it. Only contexts that occur in held-out texts are asked for, as nothing else is ever unseen.
4. Parts sum contexts and answer with what the backoff weights need, and blocks finish their documents.

Rows between blocks and parts are never more than the blocks' distinct n-grams, and carry many each until a corpus has
some hundred thousand parts. Memory is that of one block or one part.

Edge cases: null or empty text is the end token alone; rows with a null id train; repeated rows count as often as they
occur; with no training rows every count is 0; an empty table gives an empty result; a text of any length is one block
at most, in memory of about 150 bytes a word; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod_py, discard, free_shuffles, materialize, mix64, parts_for, pick, texts

BLOCK_TOKENS, BLOCK_DOCS = 600_000, 32_000
#: Tokens whose n-grams make a part.
PART_TOKENS = 1_200_000
#: Counting goes by ranges of hashes, scoring by blocks, in so many rounds, so that the shuffle files of one round are on disk at a time.
ROUNDS = 4
#: Words whose hashes a task remembers.
CACHE = 300_000
END = b" "
#: What stands before a text: no word has spaces.
START = xxhash.xxh3_64_intdigest(b"  ")
K = 5
BLOCK, ANSWER, TOTALS, STATE, CONTEXT, ASK, ALPHA = range(7)
PACKED = "at bigint, kind int, origin bigint, data binary"


def discounts(n: list[int]) -> np.ndarray:
    """d[1..K] from the counts of counts n[1..K+1]; where the Good-Turing estimate is no proper discount, (r - 1/2) / r."""
    d = np.ones(K + 1)
    top = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[r] and n[r + 1] and top < 1:
            star = (r + 1) * n[r + 1] / n[r]
            good = (star / r - top) / (1 - top)
            if 0 < good < 1:
                d[r] = good
    return d


def key(*words: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams of parallel words; each order has keys of its own."""
    k = mix64(words[0] + np.uint64(len(words)))
    for w in words[1:]:
        k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) ^ w
    return mix64(k)


def planes(x: np.ndarray) -> bytes:
    """Differences of sorted keys as byte planes: the high planes are zeros, which compression takes away."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(flat, dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def squeeze(x) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes):
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def packed(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["at", "kind", "origin", "data"])


def block_table(df: DataFrame, mod: int, held: int) -> DataFrame:
    """block, tokens, train_docs, data of (id, text)."""
    from pyspark import TaskContext

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        hashes: list[int] = []

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                hashes.append(xxhash.xxh3_64_intdigest(word))
                self[word] = n = len(hashes) - 1
                return n

        numbers, docs, own_tokens, size = Numbers(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            if docs:
                at = np.concatenate(own_tokens)
                times = np.bincount(at, minlength=len(hashes))
                order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]  # frequent words get small numbers
                rank = np.empty(len(hashes), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                index = np.ascontiguousarray(rank[at].view(np.uint8).reshape(-1, 4).T).tobytes()
                ids, out, lengths = zip(*docs)
                data = squeeze((ids, np.array(out, bool), np.array(lengths, np.int64), np.array(hashes, np.uint64)[order], index))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(at)]), pa.array([len(docs) - sum(out)]), pa.array([data], pa.binary())], names=["block", "tokens", "train_docs", "data"])
            docs.clear()
            own_tokens.clear()
            number, size = number + 1, 0
            if len(numbers) > CACHE:
                numbers.clear()
                hashes.clear()

        for names, own in texts(batches):
            for doc, text in zip(names, own):
                words = text.lower().split()
                words.append(END)
                own_tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                docs.append((doc, doc is not None and crc_mod_py(doc, mod) == held, len(words)))
                size += len(words)
                if size >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield from flush()
        yield from flush()

    return df.mapInArrow(work, "block bigint, tokens bigint, train_docs bigint, data binary")


class Block:
    """A block's tokens and its distinct n-grams, each order sorted by key.

    w, v, u: numbers of each token's word and the two before it, START being the last number. rest: the tokens
    that have a trigram. keys: the keys of the words, pairs and trigrams; pair and triple: each token's (of rest) place
    in them; pair_at and triple_at: a token that has it.
    """

    def __init__(self, data: bytes):
        self.ids, self.held, self.lengths, words, index = unsqueeze(data)
        self.w = np.ascontiguousarray(np.frombuffer(index, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        h, start = np.append(words, np.uint64(START)), len(words)
        self.v = np.roll(self.w, 1)
        self.v[self.starts] = start
        u = np.roll(self.v, 1)
        u[self.starts] = start
        inner = np.ones(len(self.w), bool)
        inner[self.starts] = False
        self.rest = np.flatnonzero(inner)
        self.train = ~self.held[self.doc]
        self.word_keys = key(h)
        self.word_order = np.argsort(self.word_keys[:-1])
        pairs, self.pair_at, self.pair = np.unique(key(h[self.v], h[self.w]), return_index=True, return_inverse=True)
        r = self.rest
        triples, at, self.triple = np.unique(key(h[u[r]], h[self.v[r]], h[self.w[r]]), return_index=True, return_inverse=True)
        self.triple_at = r[at]
        self.keys = [self.word_keys[self.word_order], pairs, triples]

    def counted(self) -> list[np.ndarray]:
        """How often the training texts have each n-gram."""
        count = lambda at, train, n: np.bincount(at[train], minlength=n)
        t = self.train
        words = count(self.w, t, len(self.word_order))[self.word_order]
        return [words, count(self.pair, t, len(self.keys[1])), count(self.triple, t[self.rest], len(self.keys[2]))]

    def contexts(self) -> list[np.ndarray]:
        """Which words and pairs stand before a word of a held-out text."""
        out = ~self.train
        words = np.bincount(self.v[out], minlength=len(self.word_keys))[:-1][self.word_order] > 0
        pairs = np.bincount(self.pair[self.rest[out[self.rest]] - 1], minlength=len(self.keys[1])) > 0
        return [words, pairs, np.zeros(len(self.keys[2]), bool)]


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys are cut into parts, each of an equal range of hashes."""
    step = (1 << 64) // parts
    bounds = np.array([k * step for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def questions(blocks: DataFrame, parts: int, of: range) -> DataFrame:
    """The n-grams of some of the parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(data)
                count, context = block.counted(), block.contexts()
                cuts = [ranges(k, parts) for k in block.keys]
                rows = []
                for p in of:
                    own = [slice(c[p], c[p + 1]) for c in cuts]
                    if any(s.start < s.stop for s in own):
                        rows.append((p, ASK, number, squeeze([(planes(k[s]), small(n[s]), np.packbits(x[s])) for k, n, x, s in zip(block.keys, count, context, own)])))
                yield packed(rows)

    return blocks.select("block", "data").mapInArrow(work, PACKED)


def rows_of(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(kind, origin, data), sorted, so that sums are the same whatever order rows come in."""
    return sorted(zip(table["kind"].to_pylist(), table["origin"].to_pylist(), table["data"].to_pylist()), key=lambda r: r[:2])


def answers(asked: DataFrame) -> DataFrame:
    """Whole counts of each block's n-grams, and of each order the counts of counts, sum and number of n-grams seen."""

    def work(table: pa.Table) -> pa.Table:
        part = table["at"][0].as_py()
        own = [(b, unsqueeze(d)) for _, b, d in rows_of(table)]
        del table
        said: list[list] = [[] for _ in own]
        totals = np.zeros((3, K + 4), np.int64)
        for order in range(3):
            keys = [unplanes(x[order][0]) for _, x in own]
            ends = np.cumsum([0, *map(len, keys)])
            flags = np.concatenate([np.unpackbits(x[order][2], count=len(k)) for (_, x), k in zip(own, keys)])
            _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            count = np.bincount(inverse, np.concatenate([x[order][1] for _, x in own])).astype(np.int64)
            context = np.bincount(inverse, flags) > 0
            mine = np.zeros(len(inverse), bool)
            mine[first] = count > 0
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                at = inverse[a:b]
                said[i].append((small(count[at]), np.packbits(mine[a:b]), np.packbits(context[at])))
            totals[order, : K + 2] = np.bincount(np.minimum(count, K + 2), minlength=K + 3)[: K + 2]
            totals[order, K + 2 :] = count.sum(), np.count_nonzero(count)
        out = [(b, ANSWER, part, squeeze(x)) for (b, _), x in zip(own, said)]
        return pa.Table.from_batches([packed([*out, (-1, TOTALS, part, squeeze(totals))])])

    return asked.groupBy("at").applyInArrow(work, PACKED)


def total_counts(rows: DataFrame) -> np.ndarray:
    """One small row a part, summed by Spark; a fixed number of numbers reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = unsqueeze(data).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x)], names=["i", "n"])

    out = np.zeros(3 * (K + 4), np.int64)
    for r in rows.select("data").mapInArrow(work, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out.reshape(3, -1)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= K, d[np.minimum(count, K)], 1.0) * count


def low_counts(at: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """By context, how many of its words were counted r = 1..K times."""
    return np.array([np.bincount(at[count == r], minlength=n) for r in range(1, K + 1)])


def scored(rows: DataFrame, shared, parts: int) -> DataFrame:
    """Blocks with their answers: the state of each block, the sums of its contexts, and the contexts it asks for."""

    def work(table: pa.Table) -> pa.Table:
        number = table["at"][0].as_py()
        d2, d3, tokens, distinct, train_docs = shared.value
        rows = rows_of(table)
        del table
        block = Block(next(d for k, _, d in rows if k == BLOCK))
        said = [unsqueeze(d) for k, _, d in rows if k == ANSWER]
        count, mine, context = ([np.concatenate([x[i][0].astype(np.int64) for x in said]) for i in range(3)], *([np.concatenate([np.unpackbits(x[i][j], count=len(x[i][0])) for x in said]).astype(bool) for i in range(3)] for j in (1, 2)))
        del said, rows
        order = block.word_order
        c1, need1 = np.empty(len(order) + 1, np.int64), np.ones(len(order) + 1, bool)
        c1[order], need1[order] = count[0], context[0]
        c1[-1] = train_docs  # the start, as a context
        c2, c3 = count[1], count[2]
        floor = np.log10(float(tokens + distinct + 1))
        v2, w2 = block.v[block.pair_at], block.w[block.pair_at]
        low = np.log10(c1[:-1] + 1.0)
        p2 = discounted(c2, d2) / (c1[v2] + 1.0)
        log2 = np.where(c2 > 0, np.log10(np.maximum(p2, 1e-300)), low[w2] - floor)
        back2 = (c2 == 0) & (c1[v2] > 0)
        rest, before = block.rest, block.pair[block.rest - 1]
        r3, total = c3[block.triple], c2[before]
        seen = r3 > 0
        score = log2[block.pair]
        score[rest[seen]] = np.log10(discounted(r3[seen], d3) / (total[seen] + 1.0))
        lower = np.ones(len(score), bool)
        lower[rest[seen]] = False
        back3 = ~seen & (total > 0)
        # Backoff weights to come: (document, context), contexts as sorted keys of words or pairs.
        late2, late3 = np.flatnonzero(lower & back2[block.pair]), np.flatnonzero(back3)
        words, word_of = np.unique(block.v[late2], return_inverse=True)
        pairs, pair_of = np.unique(before[late3], return_inverse=True)
        keys = np.concatenate([block.word_keys[words], block.keys[1][pairs]])
        by_key = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[by_key] = np.arange(len(keys))
        late = np.concatenate([place[word_of], place[len(words) + pair_of]])
        late_doc = np.concatenate([block.doc[late2], block.doc[rest[late3]]])
        asked, asked_count, is_pair = keys[by_key], np.concatenate([c1[words], c2[pairs]])[by_key], by_key >= len(words)
        sums = lambda x: np.add.reduceat(x, block.starts)
        known = sums((c1[block.w] > 0).astype(np.int64))
        base = sums(low[block.w]) - block.lengths * floor
        state = (block.ids, block.held, block.lengths, known, base, sums(score), late_doc.astype(np.int32), late.astype(np.int32), asked_count, is_pair)
        out = [(number, STATE, 0, squeeze(state))]
        # Sums over the words seen after a context: of their probabilities a level below, and of how many have each low count.
        t = np.flatnonzero(mine[1] & need1[v2])
        a, b = v2[t], np.flatnonzero(mine[2])
        pair_before = block.pair[block.triple_at[b] - 1]
        b, pair_before = b[context[1][pair_before]], pair_before[context[1][pair_before]]
        below = p2[block.pair[block.triple_at[b]]]
        n, m = len(c1), len(c2)
        has = np.concatenate([np.bincount(a, minlength=n), np.bincount(pair_before, minlength=m)]) > 0
        s = np.concatenate([np.bincount(a, (c1[w2[t]] + 1) / (tokens + distinct + 1), n), np.bincount(pair_before, below, m)])[has]
        low_ = np.concatenate([low_counts(a, c2[t], n), low_counts(pair_before, c3[b], m)], 1)[:, has]
        keys = np.concatenate([block.word_keys, block.keys[1]])[has]
        by_key = np.argsort(keys)
        keys, s, low_ = keys[by_key], s[by_key], low_[:, by_key]
        cuts = ranges(keys, parts)
        out += [(p, CONTEXT, number, squeeze((planes(keys[i:j]), s[i:j], small(low_[:, i:j])))) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        cuts = ranges(asked, parts)
        out += [(p, ASK, number, squeeze(planes(asked[i:j]))) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        return pa.Table.from_batches([packed(out)])

    return rows.groupBy("at").applyInArrow(work, PACKED)


def context_answers(rows: DataFrame) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        part = table["at"][0].as_py()
        rows = rows_of(table)
        own = [unsqueeze(d) for k, _, d in rows if k == CONTEXT]
        keys, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *[unplanes(x[0]) for x in own]]), return_inverse=True)
        total = lambda x: np.append(np.bincount(inverse, np.concatenate([np.zeros(0), *x]), len(keys)), 0.0)
        s, low = total([x[1] for x in own]), np.array([total([x[2][r] for x in own]) for r in range(K)]).astype(np.int64)
        out = []
        for k, b, d in rows:
            if k == ASK:
                asked = unplanes(unsqueeze(d))
                at = np.searchsorted(keys, asked)
                at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == asked[at < len(keys)], at[at < len(keys)], len(keys))
                out.append((b, ALPHA, part, squeeze((s[at], small(low[:, at])))))
        return pa.Table.from_batches([packed(out)])

    return rows.groupBy("at").applyInArrow(work, PACKED)


def finish(rows: DataFrame, shared) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        d2, d3, train_tokens, _, _ = shared.value
        ids, held, lengths, known, base, score, late_doc, late, count, is_pair = unsqueeze(next(d for k, _, d in rows if k == STATE))
        said = [unsqueeze(d) for k, _, d in rows if k == ALPHA]
        if said:
            s, low = np.concatenate([x[0] for x in said]), np.concatenate([x[1].astype(np.int64) for x in said], 1)
            left = sum(r * low[r - 1] * (1 - np.where(is_pair, d3[r], d2[r])) for r in range(1, K + 1))
            log_alpha = np.log10((1 + left) / (count + 1.0) / np.maximum(1 - s, 1e-300))
            score = score + np.bincount(late_doc, log_alpha[late], len(ids))
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(score)], names=names)

    return rows.groupBy("at").applyInArrow(work, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def katz_scores(df: DataFrame, mod: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of df."""
    kind, spark = df.schema[id_col].dataType.simpleString(), df.sparkSession
    sc = spark.sparkContext
    docs = pick(df, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = materialize(block_table(docs, mod, held).withColumn("turn", F.pmod("block", F.lit(ROUNDS))), "blocks", by="turn")
    size = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("docs")).first()
    parts = parts_for(size["tokens"], PART_TOKENS, sc.defaultParallelism)
    rounds = []
    for i in range(ROUNDS):
        rounds.append(materialize(answers(questions(blocks, parts, range(i * parts // ROUNDS, (i + 1) * parts // ROUNDS))), "counts"))
        free_shuffles(spark)
    said = reduce(DataFrame.unionByName, rounds)
    totals = total_counts(said.where(F.col("kind") == TOTALS))
    tokens, distinct = (int(x) for x in totals[0, K + 2 :])
    shared = sc.broadcast((discounts(totals[1].tolist()), discounts(totals[2].tolist()), tokens, distinct, size["docs"]))
    turns = []
    for i in range(ROUNDS):
        own = blocks.where(F.col("turn") == i).select(F.col("block").alias("at"), F.lit(BLOCK).alias("kind"), F.lit(0).cast("bigint").alias("origin"), "data")
        answered = said.where((F.col("kind") == ANSWER) & (F.pmod("at", F.lit(ROUNDS)) == i))
        turns.append(materialize(scored(own.unionByName(answered), shared, parts), "contexts"))
        discard(blocks, f"turn={i}")
    for done in (blocks, *rounds):
        discard(done)
    states = reduce(DataFrame.unionByName, turns)
    weights = materialize(context_answers(states.where(F.col("kind").isin(CONTEXT, ASK))), "backoff")
    free_shuffles(spark)
    out = finish(states.where(F.col("kind") == STATE).unionByName(weights), shared)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
