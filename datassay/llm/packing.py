"""Best-fit packing of tokenised documents into sequences of at most max_tokens, by hierarchical residual packing.

1. Each document becomes its token ids plus an end id. Longer ones are cut into max_tokens pieces, the
   first of which may be shorter. Full pieces are sequences already.
2. The other pieces are dealt into groups of about group_items and packed by best fit, longest first; nearly full bins
   are emitted.
3. Underfull bins are items of the next level, where fan groups merge, and so on until one group is left, which emits
   all its bins. A bin with no room for any item of any group is emitted at once. Bins of equal fill are interchangeable, so
   a merge needs only how many bins of each fill its groups have: fewer than max_tokens numbers a group, however many bins
   there are. It packs these counts by best fit, and its plan says which range of each group's bins of a fill goes where.
4. The plan is joined back to the underfull bins' pieces by group and fill.

So a task holds group_items pieces or fan * max_tokens counts, whatever the lengths are.

Edge cases: null or empty text is the end id alone; repeated rows are packed each on its own; an empty
table gives an empty result; a text may be of any length; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts_for, pick

#: Plans of up to so many rows are broadcast; a larger one has many groups, so its join is dealt evenly.
BROADCAST_PLAN = 200_000
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file's ids as little-endian uint32 bytes.

    Byte-level BPE files go through tiktoken on the file's own vocabulary, which gives the same ids about
    four times as fast; texts with a control token's text or very long runs without white space, and
    files of any other kind, go through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        before = about.get("pre_tokenizer") or {}
        self.fast = None
        if about["model"].get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not about.get("normalizer") and "merges" in about["model"]:
            chars = byte_of_char()
            ranks = {bytes(chars[c] for c in token): i for token, i in about["model"]["vocab"].items() if token not in self.special}
            merged = [m if isinstance(m, list) else m.split(" ") for m in about["model"]["merges"]]
            order = [about["model"]["vocab"]["".join(m)] for m in merged]
            if order == sorted(order):  # a merge's rank is then its token's id
                self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or len(text) > LONG_RUN and re.search(rf"\S{{{LONG_RUN}}}", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of length ids: all of most but the first, which may be shorter."""
    first = length % most or most
    return [(0, first)] + [(s, most) for s in range(first, length, most)]


def tokenized_pieces(df: DataFrame, max_tokens: int, end_id: int, tokenizer: str, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """item (a number of its own), doc_id, piece, start, length, ids_crc32 of every piece; with keep_ids, also ids."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                columns: list[list] = [[] for _ in names]
                for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), texts)):
                    ids = encoder.encode(text) + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, max_tokens)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = [n, doc, k, start, length, zlib.crc32(own)] + [np.frombuffer(own, "<i4")] * keep_ids
                        for c, v in zip(columns, row):
                            c.append(v)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t or part.column(0).type) for c, t in zip(columns, types)], names=names)

    return pick(df, id_col, text_col).mapInArrow(work, f"item bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms: list[int] = []  # the rooms that some bin has, ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = most, len(bins)
            bins.append([i])
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def best_fit_counts(counts: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """best_fit() of items given as counts by length: (lengths in a bin, how many such bins)."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], bins: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((pattern, bins))

    for need in sorted(counts, reverse=True):
        n = counts[need]
        while n:
            at = bisect.bisect_left(rooms, need)
            if at == len(rooms):
                room, pattern, bins = most, (), n  # new bins
            else:
                room = rooms[at]
                pattern, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            times = room // need
            full = min(bins, n // times)
            if full:
                put(pattern + (need,) * times, full, room - times * need)
                n -= full * times
            if n and full < bins:
                put(pattern + (need,) * n, 1, room - n * need)
                n, full = 0, full + 1
            if pattern and full < bins:
                put(pattern, bins - full, room)
    return [x for found in by_room.values() for x in found]


def number_bits(group_items: int, fan: int, level: int) -> int:
    """Bits that number the bins of a group: eight times the items that its leaves have on average."""
    return (8 * max(group_items, 64) * fan**level).bit_length()


def pack_leaves(pieces: DataFrame, most: int, slack: int, last: bool, bits: int, id_type: str) -> DataFrame:
    """The pieces of each grp with offset, sequence_id of the bins that are finished, and fill and idx (number among its group's bins of that fill) of the others."""

    def pack(table: pa.Table) -> pa.Table:
        group, lengths = table["grp"][0].as_py(), table["length"].to_pylist()
        bins = best_fit(lengths, most)
        seen: dict[int, int] = {}
        n = len(lengths)
        offset, fill, idx, sequence = (np.zeros(n, np.int64) for _ in range(4))
        done = np.zeros(n, bool)
        for k, own in enumerate(bins):
            at = 0
            for i in own:
                offset[i] = at
                at += lengths[i]
            done[own] = last or at >= most - slack
            fill[own], idx[own], sequence[own] = at, seen.get(at, 0), (group << bits) + k
            if not done[own[0]]:
                seen[at] = seen.get(at, 0) + 1
        return pa.Table.from_arrays([*(table[c] for c in PIECE), table["grp"], pa.array(fill), pa.array(idx), pa.array(offset), pa.array(sequence, mask=~done)], names=[*PIECE, "node", "fill", "idx", "offset", "sequence_id"])

    return pieces.groupBy("grp").applyInArrow(pack, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, node bigint, fill bigint, idx bigint, offset bigint, sequence_id bigint")


def merge_plan(counts: DataFrame, level: int, fan: int, most: int, slack: int, least: int, last: bool, bits: int) -> DataFrame:
    """Of (node, fill, n): the bins idx in [lo, hi) of a node's fill go to bins of parent, at shift: sequences from sequence_from on, or bins out_from on of out_fill."""

    def merge(table: pa.Table) -> pa.Table:
        parent = table["parent"][0].as_py()
        rows = sorted(zip(*(table[c].to_pylist() for c in ("fill", "node", "n"))))
        total: dict[int, int] = {}
        holds: dict[int, list[tuple[int, int, int]]] = {}  # fill -> (from, to, node)
        for fill, node, n in rows:
            a = total.get(fill, 0)
            holds.setdefault(fill, []).append((a, a + n, node))
            total[fill] = a + n
        used, passed, sequence = dict.fromkeys(total, 0), {}, (level << 58) + (parent << bits)
        for own in holds.values():
            own.reverse()  # the next one is the last
        out = []
        for pattern, bins in best_fit_counts(total, most):
            size = sum(pattern)
            done = last or size >= most - slack or most - size < least
            goes = sequence if done else passed.get(size, 0)
            if done:
                sequence += bins
            else:
                passed[size] = goes + bins
            shift = 0
            for fill in pattern:
                a, to = used[fill], goes
                used[fill] = b = a + bins
                while a < b:
                    lo, hi, node = holds[fill][-1]
                    end = min(b, hi)
                    out.append((node, fill, a - lo, end - lo, parent, size, to, shift, done))
                    to, a = to + end - a, end
                    if end == hi:
                        holds[fill].pop()
                shift += fill
        c = list(zip(*out))
        names = ["node", "fill", "lo", "hi", "parent", "out_fill", "goes", "shift"]
        return pa.Table.from_arrays([*(pa.array(x, pa.int64()) for x in c[:8]), pa.array(c[8], pa.bool_())], names=[*names, "done"])

    grouped = counts.withColumn("parent", F.floor(F.col("node") / fan).cast("bigint")).groupBy("parent")
    return grouped.applyInArrow(merge, "node bigint, fill bigint, lo bigint, hi bigint, parent bigint, out_fill bigint, goes bigint, shift bigint, done boolean")


def pack_documents(df: DataFrame, max_tokens: int = 1024, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_items: int = 20_000, fan: int = 8, slack: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    pieces = materialize(tokenized_pieces(df, max_tokens, end_id, tokenizer or default_tokenizer(), id_col, text_col), "pieces")
    columns = [*PIECE, "sequence_id", "offset"]
    out = pieces.where(F.col("length") == max_tokens).select(*PIECE, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = pieces.where(F.col("length") < max_tokens)
    groups, level = parts_for(short.count(), group_items), 0
    leaves = short.select(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"), *PIECE)
    open_ = materialize(pack_leaves(leaves, max_tokens, slack, groups == 1, number_bits(group_items, fan, 0), kind), "bins")
    counts = open_.where(F.col("sequence_id").isNull()).groupBy("node", "fill").agg((F.max("idx") + 1).alias("n"))
    while groups > 1:
        out = out.unionByName(open_.where(F.col("sequence_id").isNotNull()).select(*columns))
        rest = open_.where(F.col("sequence_id").isNull())
        groups, level = parts_for(groups, fan), level + 1
        counts = materialize(counts, "fills")
        least = counts.agg(F.coalesce(F.min("fill"), F.lit(0)).alias("fill")).first()["fill"]
        plan = materialize(merge_plan(counts, level, fan, max_tokens, slack, least, groups == 1, number_bits(group_items, fan, level)), "plan")
        ranges = plan.groupBy("node", "fill").agg(F.collect_list(F.struct("lo", "hi", "parent", "out_fill", "goes", "shift", "done")).alias("ranges"))  # as many as the merge has patterns with that fill
        ranges = F.broadcast(ranges) if plan.count() <= BROADCAST_PLAN else ranges
        to = F.filter("ranges", lambda r: (r["lo"] <= F.col("idx")) & (F.col("idx") < r["hi"]))[0]
        moved = rest.join(ranges, ["node", "fill"]).withColumn("to", to).withColumn("goes", F.col("to.goes") + F.col("idx") - F.col("to.lo"))
        moved = moved.select(*PIECE, F.col("to.parent").alias("node"), F.col("to.out_fill").alias("fill"), F.col("goes").alias("idx"), (F.col("offset") + F.col("to.shift")).alias("offset"), F.when(F.col("to.done"), F.col("goes")).alias("sequence_id"))
        open_ = materialize(moved, "bins")
        counts = plan.where(~F.col("done")).groupBy(F.col("parent").alias("node"), F.col("out_fill").alias("fill")).agg(F.max(F.col("goes") + F.col("hi") - F.col("lo")).alias("n"))
    return out.unionByName(open_.select(*columns))
