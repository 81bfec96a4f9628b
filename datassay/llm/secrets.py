"""Secret scan: fixed patterns plus a linear-chain conditional random field decoded by Viterbi.

Whitespace-separated tokens are tagged outside, begin or inside of a secret. A tag's score is a
sum over features of the token (shape, length, entropy, keywords), of its two neighbours and of
the file; transitions between tags are learned with them by maximum likelihood.

Whole texts are decoded without a Python step per token: each distinct token's scores are cached
and gathered with numpy. A token whose outside score leads by more than any pair of transitions
can win back is outside on every best path, so the chain falls apart there, exactly; only the
runs between such tokens, few and short, are decoded by Viterbi.

Edge cases: null or empty text has no spans; repeated rows are scanned each on its own; an empty
table gives an empty result; columns other than the two named are not read; a text may be of any length.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, pick, tidied

O_, B_, I_ = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and what marks a word as speaking of a secret.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CUES = (*KEYWORDS, b"pwd", b"bearer", b"basic", b"authorization", b"credential", b"passphrase", b"access_key")
PREFIXES = (b"AKIA", b"ghp_", b"gho_", b"sk-", b"sk_", b"xoxb-", b"xoxp-", b"eyJ", b"AIza", b"glpat-")
TRIM = b"\"'<>(),;.[]{}`"
LENGTHS = (4, 8, 16, 24, 40)

FEATURES = [
    "one", *[f"len<{n}" for n in LENGTHS], "long", "lower", "upper", "digit", "sign", "mix", "mix3", "digits", "hex",
    "entropy3", "entropy4", "cue", "cue=", "=", "joins", "url", "at", "prefix", "begin", "end", "b64", "base", "gone",
]
AT = {name: i for i, name in enumerate(FEATURES)}
FILE = ["assignments", "digits"]


def base_spans(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of the fixed patterns; a cheap substring test keeps the patterns off most texts."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


PLAIN = re.compile(rb"[A-Za-z\x80-\xff]+[!-,.;?]*")
CUE = re.compile(b"|".join(CUES), re.IGNORECASE)


def plain(word: bytes) -> tuple[int, bool, bool, bool] | None:
    """What the features of an ordinary word depend on, if it is one: these few cases share their scores."""
    if not PLAIN.fullmatch(word) or CUE.search(word) or word.startswith(PREFIXES):
        return None
    core = word.strip(TRIM)
    n = len(core)
    return next((x for x in LENGTHS if n < x), 0), core != core.lower(), core != core.upper(), not core.isalpha() and core.isascii()


def shape(word: bytes) -> list[int]:
    """The features of one token, by number."""
    on = [AT["one"]]
    if ordinary := plain(word):
        length, upper, lower, sign = ordinary
        return [*on, AT[f"len<{length}" if length else "long"], *[AT[k] for k, v in (("upper", upper), ("lower", lower), ("sign", sign)) if v]]
    core = word.strip(TRIM)
    n = len(core)
    on.append(AT[next((f"len<{x}" for x in LENGTHS if n < x), "long")])
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in core)
    digits = sum(48 <= c <= 57 for c in core)
    low = core.lower()
    if letters and core != low:
        on.append(AT["upper"])
    if any(97 <= c <= 122 for c in core):
        on.append(AT["lower"])
    if digits:
        on.append(AT["digit"])
    if letters + digits < n:
        on.append(AT["sign"])
    if letters and digits:
        on.append(AT["mix"])
        runs = sum((48 <= a <= 57) != (48 <= b <= 57) for a, b in zip(core, core[1:]))
        if runs >= 3 and n >= 12:
            on.append(AT["mix3"])
    if digits and not letters:
        on.append(AT["digits"])
    if n >= 16 and not low.strip(b"0123456789abcdef"):
        on.append(AT["hex"])
    if n >= 12:
        counts = [core.count(c) for c in set(core)]
        entropy = -sum(c / n * math.log2(c / n) for c in counts)
        if entropy >= 4:
            on.append(AT["entropy4"])
        elif entropy >= 3:
            on.append(AT["entropy3"])
    if n >= 20 and digits and not core.strip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"):
        on.append(AT["b64"])
    if any(c in low for c in CUES):
        on.append(AT["cue="] if re.search(rb"[:=]", word) else AT["cue"])
    if word in (b"=", b":", b"=>", b":="):
        on.append(AT["="])
    elif b"=" in core.rstrip(b"="):
        on.append(AT["joins"])
    if b"://" in word:
        on.append(AT["url"])
    if b"@" in word:
        on.append(AT["at"])
    if core.startswith(PREFIXES) and n >= 16:
        on.append(AT["prefix"])
    if core.startswith(b"-----BEGIN"):
        on.append(AT["begin"])
    if core.startswith(b"-----END") or core.endswith(b"KEY-----"):
        on.append(AT["end"])
    if base_spans(word):
        on.append(AT["base"])
    return on


def file_features(text: bytes) -> list[int]:
    """Whether the file has assignments, and whether over a tenth of it is digits."""
    digits = len(text) - len(text.translate(None, b"0123456789"))
    return [0] * (b"=" in text) + [1] * (digits * 10 > len(text))


def examples(count: int, seed: int) -> list[tuple[list[bytes], list[int]]]:
    """Labelled training sequences: prose with harmless numbers, and secrets of several kinds set into it."""
    r = random.Random(seed)
    chars = "abcdefghijklmnopqrstuvwxyz"
    b64 = chars + chars.upper() + "0123456789+/"

    def run(of: str, least: int, most: int) -> str:
        return "".join(r.choice(of) for _ in range(r.randint(least, most)))

    def word() -> str:
        w = run(chars, 1, 10) + r.choice(["", "", "", "", "", "", ".", ",", "!!", "***", "?"])
        w = r.choice([w, w, w, w.capitalize(), w.upper(), w[:3] + "é" + w[3:], run(chars, 14, 26)])
        return w

    def harmless() -> list[str]:
        d = "0123456789"
        return [
            [run(d, 1, 16)], ["+1", f"({run(d, 3, 3)})", f"{run(d, 3, 3)}-{run(d, 4, 4)}"], [f"{run(chars, 4, 6)}.{run(d, 1, 2)}@mail{run(d, 1, 1)}.example.com"],
            [".".join(run(d, 1, 3) for _ in range(4))], ["version", f"{run(d, 1, 1)}.{run(d, 1, 1)}"], [f"https://{run(chars, 4, 9)}.example.org/{run(chars, 2, 8)}/{run(d, 2, 5)}"], [f"20{run(d, 2, 2)}-0{run('123456789', 1, 1)}-1{run(d, 1, 1)}"],
            ["the", "password", word()], ["a", "token", word()], ["=", word()], [f"x={run(d, 1, 3)}"], [f"{run(chars, 3, 8)}_{run(chars, 3, 8)}({run(chars, 1, 4)})"], ["secret", word(), word()], [f"{run(chars, 3, 6)}{run(d, 1, 3)}"], ["CC", "BY-NC", "4.0."],
        ][r.randrange(15)]

    def secret() -> tuple[list[str], list[int]]:
        q = r.choice(["", '"', "'"])
        key, name = run(b64, 18, 48), r.choice(["password", "secret", "token", "api_key", "passwd", "client_secret", "pwd"])
        hexa, m = run("0123456789abcdef", 16, 40), r.randint(1, 4)
        return [
            ([f"{name}={q}{r.choice([key, hexa])}{q}"], [B_]), ([name, r.choice("=:"), f"{q}{r.choice([key, hexa])}{q}"], [O_, O_, B_]), ([f"{name}:", f"{q}{r.choice([key, hexa])}{q}"], [O_, B_]),
            (["AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 16)], [B_]), (["Authorization:", r.choice(["Bearer", "Basic"]), key], [O_, O_, B_]), (["bearer", r.choice(["ghp_", "sk-", "xoxb-"]) + run(chars + "0123456789", 20, 36)], [O_, B_]),
            (["eyJ" + run(b64, 20, 40) + "." + run(b64, 20, 40)], [B_]), ([r.choice(["ghp_", "glpat-", "sk_"]) + run(b64[:52] + "0123456789", 20, 36)], [B_]), ([hexa + run("0123456789abcdef", 16, 24)], [B_]),
            (["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *[run(b64, 40, 64) for _ in range(m)], "-----END", "RSA", "PRIVATE", "KEY-----"], [B_] + [I_] * (m + 7)), ([name, "is", run(b64[:52] + "0123456789", 12, 24)], [O_, O_, B_]),
        ][r.randrange(11)]

    out = []
    for _ in range(count):
        words, tags = [], []
        for _ in range(r.randint(2, 5)):
            for _ in range(r.randint(1, 4)):
                words.append(word())
                tags.append(O_)
            more, own = secret() if r.random() < 0.35 else (h := harmless(), [O_] * len(h))
            words += more
            tags += own
        out.append(([w.encode() for w in words], tags))
    return out


class Crf:
    """Weights: own, left and right neighbour (features x 3 tags each), file (features x 3), transitions (3 x 3)."""

    def __init__(self, own, left, right, file, moves):
        self.own, self.left, self.right, self.file, self.moves = own, left, right, file, moves
        m = moves
        gain = max(m[p, y] + m[y, n] - m[p, O_] - m[O_, n] for p in range(3) for n in range(3) for y in (B_, I_))
        #: An outside lead above this can't be won back by the two transitions a token takes part in.
        self.safe = float(gain) + 1e-9

    @classmethod
    def train(cls, count: int = 900, steps: int = 100, seed: int = 7, ridge: float = 2e-3) -> Crf:
        """Maximum likelihood by full-batch Adam with the forward-backward algorithm; count bounds the labelled sequences."""
        data = examples(count, seed)
        n, length, width = len(data), max(len(w) for w, _ in data), len(FEATURES)
        x = np.zeros((n, length, 3 * width + len(FILE)))
        tags, lengths = np.zeros((n, length), int), np.array([len(w) for w, _ in data])
        for i, (words, own) in enumerate(data):
            for t, word in enumerate(words):
                on = shape(word)
                x[i, t, on] = 1
                if t + 1 < len(words):
                    x[i, t + 1, [width + k for k in on]] = 1
                if t:
                    x[i, t - 1, [2 * width + k for k in on]] = 1
            x[i, : len(words), [3 * width + k for k in file_features(b" ".join(words))]] = 1
            x[i, 0, width + AT["gone"]] = x[i, len(words) - 1, 2 * width + AT["gone"]] = 1
            tags[i, : len(own)] = own
        real = np.arange(length)[None] < lengths[:, None]
        gold = np.eye(3)[tags] * real[..., None]
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (tags[:, :-1][real[:, 1:]], tags[:, 1:][real[:, 1:]]), 1)
        flat = x[real]
        w, m = np.zeros((x.shape[2], 3)), np.zeros((3, 3))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
        for step in range(1, steps + 1):
            e = np.zeros((n, length, 3))
            e[real] = flat @ w
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for t in range(1, length):
                a[:, t] = np.where(real[:, t, None], e[:, t] + _lse(a[:, t - 1, :, None] + m, 1), a[:, t - 1])
            for t in range(length - 2, -1, -1):
                b[:, t] = np.where(real[:, t + 1, None], _lse(m + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
            z = _lse(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            q = a[:, :-1, :, None] + m + (e + b)[:, 1:, None, :] - z[:, None, None, None]
            q = np.exp(np.where(real[:, 1:, None, None], q, -np.inf))
            gw = flat.T @ (p - gold)[real] / n + ridge * w
            gm = (q.sum((0, 1)) - pairs) / n + 20 * ridge * m
            for k, (v, g) in enumerate(((w, gw), (m, gm))):
                first, second = state[2 * k], state[2 * k + 1]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                v -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(w[:width], w[width : 2 * width], w[2 * width : 3 * width], w[3 * width :], m)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags of a run whose neighbours on both sides, if any, are outside (their moves are in e)."""
        best, back = e[0], []
        for row in e[1:]:
            reach = best[:, None] + self.moves
            back.append(reach.argmax(0))
            best = reach.max(0) + row
        tag = int(best.argmax())
        out = [tag]
        for b in reversed(back):
            out.append(tag := int(b[tag]))
        return out[::-1]

    def decode(self, e: np.ndarray, exact: bool = False) -> np.ndarray:
        """Tags of one text; exact=True runs Viterbi over all of it, for tests."""
        tags = np.zeros(len(e), int)
        open_ = np.ones(len(e), bool) if exact else e[:, O_] - e[:, 1:].max(1) <= self.safe
        where = np.flatnonzero(open_)
        if not len(where):
            return tags
        for run in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
            part = e[run].copy()
            if run[0] > 0:
                part[0] += self.moves[O_]
            if run[-1] + 1 < len(e):
                part[-1] += self.moves[:, O_]
            tags[run] = self.viterbi(part)
        return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Scores(dict):
    """Token -> number of its row of cached scores; it forgets all beyond limit distinct tokens, for bounded memory."""

    def __init__(self, crf: Crf, limit: int = 400_000):
        super().__init__()
        self.crf, self.limit = crf, limit
        self.reset()

    def reset(self):
        self.clear()
        self.plain: dict[tuple, int] = {}
        gone = [AT["gone"]]
        self.rows = [np.concatenate([w[gone].sum(0) for w in (self.crf.own, self.crf.left, self.crf.right)])]
        self.table = None

    def __missing__(self, word: bytes) -> int:
        if ordinary := plain(word):
            if ordinary not in self.plain:
                self.plain[ordinary] = self.row(word)
            self[word] = n = self.plain[ordinary]
            return n
        self[word] = n = self.row(word)
        return n

    def row(self, word: bytes) -> int:
        on = shape(word)
        self.rows.append(np.concatenate([w[on].sum(0) for w in (self.crf.own, self.crf.left, self.crf.right)]))
        return len(self.rows) - 1

    def emissions(self, words: list[bytes], text: bytes) -> np.ndarray:
        if len(self) > self.limit:
            self.reset()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.table is None or len(self.table) < len(self.rows):
            have = 0 if self.table is None else len(self.table)
            new = np.array(self.rows[have:])
            self.table = new if not have else np.concatenate([self.table, new])
        e = self.table[ids, :3] + self.crf.file[file_features(text)].sum(0)
        e[1:] += self.table[ids[:-1], 3:6]
        e[:-1] += self.table[ids[1:], 6:9]
        e[0] += self.table[0, 3:6]
        e[-1] += self.table[0, 6:9]
        return e


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def core(text: bytes, start: int, end: int) -> tuple[int, int]:
    """A tagged run without what surrounds the secret itself: a name before = or :, quotes and brackets."""
    joined = re.match(rb"[\"'A-Za-z_-]{2,24}[=:](?!//)(?=.{6})", text[start:end])
    start += joined.end() if joined else 0
    while start < end and text[start] in TRIM:
        start += 1
    while end > start and text[end - 1] in TRIM:
        end -= 1
    return start, end


def union(base: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def covered(start: int, end: int, stretches: tuple[list[int], list[int]]) -> bool:
    """Whether one of the stretches covers start to end wholly; a run of which they hold only a part is still a span of its own."""
    at = bisect_right(stretches[0], start) - 1
    return at >= 0 and stretches[1][at] >= end


def spans(text: bytes, scores: Scores, exact: bool = False) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans) as (start, kind, end) in code points."""
    base = base_spans(text)
    words, more = text.split(), []
    if words:
        tags = scores.crf.decode(scores.emissions(words, text), exact)
        if tags.any():
            at = [m.span() for m in WORD.finditer(text)]
            runs: list[list[int]] = []
            stretches = union(base)
            for t in np.flatnonzero(tags):
                if runs and tags[t] == I_ and runs[-1][1] == t - 1:
                    runs[-1][1] = t
                else:
                    runs.append([t, t])
            for first, last in runs:
                s, e = core(text, at[first][0], at[last][1])
                if e - s >= 6 and not covered(s, e, stretches):
                    more.append((s, "crf", e))
    both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))
    if text.isascii() or not both:
        return base, both
    # Code points before a byte: the bytes before it that do not continue one.
    points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
    base, both = ([(int(points[s]), k, int(points[e])) for s, k, e in x] for x in (base, both))
    return base, both


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """One row per row of df: id_col and spans (array of kind, start, end in code points).

    One pass with no shuffle. The model is small and fixed in size, so it travels with the task.
    """
    model = crf or Crf.train()
    kind = df.schema[id_col].dataType.simpleString()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(text, scores)[1]] for text in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=[id_col, "spans"])

    return pick(df, id_col, text_col).mapInArrow(tidied(scan), f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def scan_secrets_in_place(df: DataFrame, mark: str, text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """df with each secret in its text replaced by mark; all other columns pass through, and a null text stays null."""
    model = crf or Crf.train()
    at = df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            texts = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                both = spans(raw, scores)[1] if raw else []
                text = None if raw is None else raw.decode("utf-8", "replace")
                texts.append(blank(text, both, mark) if both else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=df_names)

    df_names = df.columns
    return df.mapInArrow(tidied(scan), df.schema)


def blank(text: str, found: list[tuple[int, str, int]], mark: str) -> str:
    """text with the union of the spans replaced by mark, one for each stretch."""
    out, at = [], 0
    for s, _, e in found:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans and all spans, per row of df."""
    found = scan_secrets(df, id_col, text_col)
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col(id_col), count("assign"), count("access"), count("hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
