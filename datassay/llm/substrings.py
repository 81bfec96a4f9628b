"""Substring dedup: words under a window that occurred before are removed, found by FM-indexes over shards of the corpus.

A window is `width` consecutive words of one document. A word is removed if a window covers it whose words also start
earlier: in a document of smaller id, or earlier in the same one. Windows are judged on the input.

1. Equal windows have the same smallest hash among their GRAM-word stretches. A document is cut where that stretch changes,
   so a segment (about seven windows, with the words that they cover) goes by one hash, its anchor. Windows whose anchor
   occurs once in the corpus occur once, and end here; a semi-join with the counts of anchors leaves the others.
2. Segments of equal anchor and words are one, held at its first place. Distinct segments get their words by one join
   with the texts and go to shards by anchor; equal windows are always in one shard, of about SHARD_WORDS words.
   An anchor of more than `hot` distinct segments is cut into single windows, which go by anchor and words, so that equal
   ones become one before any shard sees them.
3. A shard lays its segments out in the order of documents and builds an FM-index: suffix array by prefix doubling,
   Burrows-Wheeler transform, wavelet tree. Every segment is streamed through backward search, all at a time; the
   matching statistics against what is earlier say which stretches of `width` words and more repeat.
4. A segment that is not the first of its equals matches it in whole. Stretches are gathered by document, which one
   more join brings to the texts.

Anchors and equal segments are told by 64-bit hashes (two for a segment); the index compares words themselves.

Edge cases: null and empty texts have no words; texts shorter than a window keep all; texts of any length are read whole, in
memory of some 50 bytes a byte of the longest; rows that repeat an id and its text are one document and get the
same result each; other texts under one id are documents one after the other, by a hash of the text; null ids come last;
an empty table gives an empty result; other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, discard, free_shuffles, materialize, pick
from .fm import FmIndex
from .wordcodes import Sums, hashes, pieces, spans

#: Words of the stretches that anchors are chosen from, and bits of a stretch's place beside its hash where the smallest is chosen.
GRAM, PLACE_BITS = 8, 24
#: Words to a shard, and distinct segments of an anchor up to which it stays whole.
SHARD_WORDS, HOT = 400_000, 4_000


def cut(h: np.ndarray, doc: np.ndarray, width: int, gram: int, most: int = 1 << PLACE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, anchors, contents) of the segments of word hashes h: runs of windows of one text with their anchor, the leftmost smallest stretch, in one place."""
    out = [[], [], [], []]
    step = most - width  # places inside a slice have PLACE_BITS bits
    for at in range(0, max(1, len(h) - width + 1), step):
        own, of = h[at : at + step + width - 1], doc[at : at + step + width - 1]
        n, choices = len(own) - width + 1, width - gram + 1
        windows = np.flatnonzero(of[: max(n, 0)] == of[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        sums = Sums(own)
        places = np.arange(max(0, len(own) - gram + 1))
        grams = sums.of(places, places + gram)
        low = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | places.astype(np.uint64)
        # Minima over `choices` stretches, from minima over powers of two.
        span = 1
        while span * 2 <= choices and n > 0:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        low = np.minimum(low[: max(n, 0)], low[choices - span : choices - span + max(n, 0)])
        place = (low[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        count, starts = np.diff(np.append(first, len(windows))), windows[first]
        for own, x in zip(out, (starts + at, count, grams[place[first]], sums.of(starts, starts + count + width - 1))):
            own.append(x)
    return tuple(np.concatenate(x) for x in out)


def numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, documents), both (doc, id, text): doc orders the documents; it is the id where ids are unique and not null. A document is there once."""
    docs = pick(df, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if docs.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        rows = docs.select(F.col("id").alias("doc"), "id", "text")
        return rows, rows
    own = docs.withColumn("k", F.xxhash64("text"))
    order = own.select("id", "k").distinct().repartitionByRange(F.col("id").asc_nulls_last(), "k").sortWithinPartitions(F.col("id").asc_nulls_last(), "k")
    order = materialize(order.select(F.monotonically_increasing_id().alias("doc"), F.col("id").alias("i"), F.col("k").alias("j")), "order")
    rows = own.join(order, F.col("id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("j"))).select("doc", "id", "text")
    return rows, rows.dropDuplicates(["doc"])


def segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(anchor, content, doc, start, n) of every segment of (doc, id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in pieces(batch.column(1)):
                begins, ends, text = spans(data, offsets)
                starts, n, anchor, content = cut(hashes(data, begins, ends), text, width, gram)
                own = text[starts]
                first = np.searchsorted(text, own)  # the text's first word
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[at + own]), pa.array((starts - first).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "content", "doc", "start", "n"])

    return docs.select("doc", "text").mapInArrow(work, "anchor bigint, content bigint, doc bigint, start int, n int")


def with_words(docs: DataFrame, wanted: DataFrame, width: int, whole: bool) -> DataFrame:
    """wanted (anchor, content, doc, start, n) with the segments' words; or, not whole, one row a window, with the window's hash for content and no words."""
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "anchor", "content")).alias("own"))
    rows = docs.select("doc", "text").join(by_doc, "doc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = batch.column(2).values, batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            fields = {name: own.field(name).to_numpy() for name in ("start", "n", "anchor", "content")}
            row, from_ = np.repeat(np.arange(batch.num_rows), size), int(lists.offsets[0].as_py())
            fields = {k: v[from_ : from_ + len(row)] for k, v in fields.items()}
            docs_of = batch.column(0).to_numpy()
            for at, data, offsets in pieces(batch.column(1)):
                begins, ends, text = spans(data, offsets)
                mine = np.flatnonzero((row >= at) & (row < at + len(offsets) - 1))
                base = np.searchsorted(text, row[mine] - at)
                start, n = fields["start"][mine].astype(np.int64), fields["n"][mine].astype(np.int64)
                doc, anchor, content = docs_of[row[mine]], fields["anchor"][mine], fields["content"][mine]
                words = None
                if whole:
                    lo, hi = begins[base + start], ends[base + start + n + width - 2]
                    raw = data.tobytes()
                    words = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
                else:
                    k = np.repeat(np.arange(len(n)), n)
                    at_ = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                    content = Sums(hashes(data, begins, ends)).of(base[k] + at_, base[k] + at_ + width).view(np.int64)
                    doc, anchor, start, n = doc[k], anchor[k], at_, np.ones(len(k), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words if whole else [None] * len(n), pa.binary())], names=["anchor", "content", "doc", "start", "n", "words"])

    return rows.mapInArrow(work, "anchor bigint, content bigint, doc bigint, start int, n int, words binary")


def search_shard(doc: np.ndarray, start: np.ndarray, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length): the stretches of a shard's segments that repeat what is earlier, by an FM-index of them all."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    numbers: dict[bytes, int] = {}
    own = [[numbers.setdefault(w, len(numbers) + 1) for w in words[i].split()] for i in order.tolist()]
    size = np.array([len(x) for x in own], np.int64)
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    ids = np.zeros(int(ends[-1]) + 1, np.int64)
    ids[np.repeat(begins, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.fromiter((w for x in own for w in x), np.int64, int(size.sum()))
    index = FmIndex(ids)
    # From each segment's end first: most match in whole, and in the others each window before the match is searched by itself.
    m = index.matches(ids, begins, ends, width, earlier=True)
    found = [(np.flatnonzero(m > 0), m[m > 0], ends[m > 0])]
    part = np.flatnonzero(m < size)
    others = size[part] - np.maximum(m[part], width)  # windows that begin before what is found
    more = np.repeat(part, others)
    end = begins[more] + width + np.arange(len(more)) - np.repeat(np.cumsum(others) - others, others)
    m = index.matches(ids, begins[more], end, width, earlier=True)
    found.append((more[m > 0], m[m > 0], end[m > 0]))
    which, m, end = (np.concatenate(x) for x in zip(*found))
    return doc[which], start[which] + (end - m - begins[which]), m


def repeated_stretches(docs: DataFrame, width: int = 20, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(doc, start, length): stretches of words of (doc, id, text) that windows cover whose words start earlier, overlaps included."""
    spark = docs.sparkSession
    if not 0 < gram < width:
        raise ValueError("gram is between 0 and width")
    every = materialize(segments(docs, width, gram), "segments")
    # A table of its own: between two tables, Spark splits a join's hot keys.
    again = materialize(every.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    some = materialize(every.join(again, "anchor", "left_semi"), "candidates")
    discard(every)
    many = materialize(some.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start", "n")).alias("f")).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot-anchors")
    cold = some
    if not many.isEmpty():
        single = with_words(docs, some.join(many, "anchor", "left_semi"), width, whole=False).drop("words")
        cold = materialize(some.join(many, "anchor", "left_anti").withColumn("single", F.lit(False)).unionByName(single.withColumn("single", F.lit(True))), "candidates")
        discard(some)
    else:
        cold = some.withColumn("single", F.lit(False))
    first = materialize(cold.groupBy("anchor", "content", "single").agg(F.min(F.struct("doc", "start", "n")).alias("f"), F.count("*").alias("times")), "firsts")
    total = first.agg(F.sum(F.col("f.n") + width)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    # An equal window needs another segment of the same anchor.
    texts = with_words(docs, first.select("anchor", "content", "f.doc", "f.start", "f.n"), width, whole=True)
    lone = first.where("single").select("anchor").distinct()
    by = F.col("anchor") if lone.isEmpty() else None
    if by is None:
        # A cut anchor's windows go by their words as well.
        texts = texts.join(F.broadcast(lone.withColumn("cut", F.lit(1))) if lone.count() <= 1_000_000 else lone.withColumn("cut", F.lit(1)), "anchor", "left")
        by = F.when(F.col("cut").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", "content"))
    texts = texts.select(F.pmod(F.xxhash64(by), F.lit(shards)).alias("shard"), "doc", "start", "words")

    def work(table: pa.Table) -> pa.Table:
        doc, start, length = search_shard(table["doc"].to_numpy(), table["start"].to_numpy(), table["words"].to_pylist(), width)
        return pa.table({"doc": pa.array(doc), "start": pa.array(start.astype(np.int32)), "length": pa.array(length.astype(np.int32))})

    searched = materialize(texts.groupBy("shard").applyInArrow(work, "doc bigint, start int, length int"), "searched")
    own = cold.join(first.where("times > 1").select("anchor", "content", "single", F.col("f.doc").alias("d"), F.col("f.start").alias("s")), ["anchor", "content", "single"])
    later = own.where((F.col("doc") != F.col("d")) | (F.col("start") != F.col("s"))).select("doc", "start", (F.col("n") + width - 1).alias("length"))
    free_shuffles(spark)
    return later.unionByName(searched)


def remove_repeats(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """id_col, n_words, n_removed, kept: a row for each row of df; kept is what stays, joined by single spaces."""
    kind = df.schema[id_col].dataType.simpleString()
    docs, once = numbered(df, id_col, text_col)
    found = repeated_stretches(once, width, gram, shard_words, hot)
    found = materialize(found.groupBy("doc").agg(F.collect_list(F.struct("start", "length")).alias("found")), "stretches")
    rows = docs.join(found, "doc", "left").select("id", "text", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, found in zip(binary(batch.column(1)), batch.column(2)):
                words = text.split()
                total.append(len(words))
                if found.is_valid:
                    start, length = (found.values.field(k).to_numpy() for k in ("start", "length"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, stays.tolist()))
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = rows.mapInArrow(work, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
