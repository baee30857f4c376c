"""Sequence packing as a cutting-stock problem: column generation over the histogram of piece lengths."""

from __future__ import annotations

import re
import warnings
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm._common import bounded_batches, plain, read, stash

SEQUENCE = 4096
#: Id appended to each document.
END = 2
#: Lengths are priced in units of so many tokens; a class holds the lengths that round up to it.
UNIT = 8
#: Words whose ids a worker keeps, in each of two generations.
KNOWN_WORDS = 150_000
#: Stop when the linear program is proven within this share of its optimum.
GAP = 5e-4
ROUNDS = 4000
#: Columns that one knapsack table may add, and the share of the best prices so far in those that it works by.
COLUMNS, STEADY = 64, 0.7

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: A letter or digit that stays one under the tokenizer's normaliser (which writes some others, such as a dotted capital I, as a letter and a mark), before a mark that starts a new piece.
BEFORE_MARK = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([.,])"


def byte_letters() -> dict[int, int]:
    """The characters that byte-level tokenizers write bytes as: printable ones stand for themselves, the others for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in own else 256 + k for k, b in enumerate([*own, *(b for b in range(256) if b not in own)], -len(own))}


class WordIds:
    """Ids of whole texts from a tokenizers file whose pieces never cross white space.

    Every distinct word goes through the tokenizer once and its ids are kept: words of the present and the
    last generation, each of KNOWN_WORDS at most. A word of letters only is one piece, which goes to the
    tokenizer's model after its normaliser; other words go through the whole tokenizer. Lower-casing A-Z and
    a space before a full stop or comma that follows a plain letter or digit change no id: the tokenizer
    lower-cases and starts a new piece there itself. Both only make words repeat more. A text that holds the
    string of a special token goes through the tokenizer as it is, which gives that token's id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are lower-cased, so a special token's string in one is ordinary text
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.bytes = byte_letters()
        self.now: dict[str, np.ndarray] = {}
        self.before: dict[str, np.ndarray] = {}

    def ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words without white space."""
        normal = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ") if self.tokenizer.normalizer else words
        model, known = self.tokenizer.model, self.bytes
        whole = len(normal) == len(words)
        out = [[t.id for t in model.tokenize(n if n.isascii() else n.encode().decode("latin-1").translate(known))] if n.isalpha() else None for n in normal] if whole else [None] * len(words)
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        now, before = self.now, self.before
        found = list(map(now.get, words))
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            x = before.get(words[k])
            if x is None:
                new.append(k)
            else:
                found[k] = now[words[k]] = x
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for k, ids in zip(part, self.ids([words[k] for k in part]), strict=True):
                found[k] = now[words[k]] = array("I", ids).tobytes()
        if len(now) > KNOWN_WORDS:
            self.before, self.now = now, {}
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch."""
        texts = plain(texts)
        marked = pc.match_substring_regex(texts, self.special) if self.special else None
        if marked is not None and pc.any(marked).as_py():
            return self.mixed(texts, marked)
        spaced = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), BEFORE_MARK, r"\1 \2"), "\n", " ")
        lists = pc.split_pattern(spaced, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        del spaced, lists
        ids = self.look_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), np.uint32)
        which = np.asarray(coded.indices)
        n = size[which]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum()))
        at += np.repeat(first[which] - ends + n, n)
        return np.concatenate(([0], ends))[offsets - offsets[0]], flat[at]

    def mixed(self, texts: pa.Array, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As __call__, with the marked texts encoded as they are."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        offsets, ids = self(pc.if_else(marked, "", texts))
        parts = [ids[s:e] for s, e in zip(offsets, offsets[1:], strict=False)]
        for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            parts[k] = np.array(whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts)


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: whole sequences of a document from its start, then what is left of it."""

    def run(batches):
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordIds(tokenizer)
        word_ids = _LOADED[tokenizer]
        for b in batches:
            offsets, ids = word_ids(b.column(1))
            total = np.diff(offsets) + 1
            count = -(-total // sequence)
            doc = np.repeat(np.arange(len(total)), count)
            start = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * sequence
            length = np.minimum(sequence, total[doc] - start)
            crc = np.empty(len(doc), np.int64)
            for k, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                part = ids[offsets[d] + s : min(offsets[d] + s + n, offsets[d + 1])].astype("<u4")
                part = part if s + n < total[d] else np.append(part, np.array([END], "<u4"))
                crc[k] = zlib.crc32(part.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By dynamic programming, for every room up to this: the most value that fits, and the size to take first for it (0: none)."""
    by_size = np.zeros(room + 1)
    by_size[size] = np.maximum(value, 0)
    best, take = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        total = by_size[1 : w + 1] + best[w - 1 :: -1][:w]
        k = int(total.argmax())
        best[w], take[w] = total[k], k + 1
    return by_size, best, take


def patterns_of(value: np.ndarray, size: np.ndarray, room: int, most: int = COLUMNS) -> list[tuple[float, np.ndarray]]:
    """(value, counts of classes) of the multiset of classes of most value that fits in room, and of the best that hold one class each; best first, all different."""
    by_size, best, take = knapsack(value, size, room)
    with_one = by_size[size] + best[room - size]
    out, seen = [], set()
    for k in np.argsort(-with_one, kind="stable")[: 2 * most].tolist():
        counts, w = np.zeros(room + 1, np.int64), room - int(size[k])
        counts[size[k]] = 1
        while w > 0 and take[w]:
            counts[take[w]] += by_size[take[w]] > 0
            w -= int(take[w])
        pattern = counts[size]
        if (key := pattern.tobytes()) not in seen:
            seen.add(key)
            out.append((float(with_one[k]), pattern))
        if len(out) == most:
            break
    return out


def first_fit_patterns(size: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns of first fit, largest first, each used as often as what is left allows."""
    left, out = demand.astype(np.int64).copy(), []
    top = len(size) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        pattern, w = np.zeros(len(size), np.int64), room
        k = top
        while k >= 0 and w >= size[0]:
            k = min(k, int(np.searchsorted(size, w, side="right")) - 1)
            if k >= 0 and left[k]:
                n = min(w // int(size[k]), int(left[k]))
                pattern[k] = n
                w -= n * int(size[k])
            k -= 1
        full = pattern > 0
        left[full] -= pattern[full] * int((left[full] // pattern[full]).min())
        out.append(pattern)
    return out


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan's steps on whole rows. (The library's call may never return in a driver whose process also runs a gateway.)"""
    n = len(matrix)
    both = np.concatenate((matrix.astype(float), np.eye(n)), axis=1)
    for k in range(n):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        other = np.flatnonzero(both[:, k])
        other = other[other != k]
        both[other] -= np.outer(both[other, k], both[k])
    return both[:, n:]


def cutting_stock(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[tuple[float, np.ndarray]], float]:
    """Patterns and how often each is used in an optimum of the linear program min sum(x), Ax = demand; and the least bound of the number of sequences that pricing proves.

    Starts from one pattern per class, then takes the patterns of first fit, then those that the knapsack prices,
    several from one table, by prices that are held near the best so far. A revised simplex keeps the inverse of the
    basis; it has a row per class, however many documents there are. It ends when the bound is within GAP.
    """
    m = len(size)
    scale = demand.sum()
    b = demand / scale * (1 + 1e-6 * np.random.default_rng(m).random(m))  # ties broken, so that no step is degenerate
    repeat = room // size
    columns = [np.where(np.arange(m) == k, repeat[k], 0) for k in range(m)]
    inverse = np.diag(1.0 / repeat)
    x = b / repeat
    price = inverse.sum(axis=0)
    pivots = 0

    def enter(pattern: np.ndarray) -> bool:
        nonlocal x, price, inverse, pivots
        own = np.flatnonzero(pattern)
        gain = float(price[own] @ pattern[own])
        if gain <= 1 + 1e-6:
            return False
        d = inverse[:, own] @ pattern[own]
        ratio = np.where(d > 1e-11, x / np.where(d > 1e-11, d, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * d, 0)
        x[out] = theta
        row = inverse[out] / d[out]
        some = np.flatnonzero(row)
        if len(some) < m // 2:
            inverse[:, some] -= np.outer(d, row[some])
        else:
            inverse -= np.outer(d, row)
        inverse[out] = row
        price = price - (gain - 1) * row
        columns[out] = pattern
        pivots += 1
        if pivots % 500 == 0:
            inverse = inverse_of(np.stack(columns, axis=1))
            x = np.maximum(inverse @ b, 0)
            price = inverse.sum(axis=0)
        return True

    for pattern in first_fit_patterns(size, demand, room):
        enter(pattern)
    # each size its part of the room: prices that no pattern beats, so the pieces' whole size is a first bound
    best, bound = size / room, float(size @ b) / room
    for _ in range(ROUNDS):
        if float(x.sum()) <= bound * (1 + GAP):
            break
        entered = 0
        for share in (STEADY, 0.0):  # prices near the best ones so far, and where no pattern of theirs is of use, the basis's own
            mixed = share * best + (1 - share) * price
            priced = patterns_of(mixed, size, room)
            own = float(mixed @ b) / max(priced[0][0], 1.0)
            if own > bound:
                best, bound = mixed / max(priced[0][0], 1.0), own
            entered = sum([enter(pattern) for _, pattern in priced])
            if entered:
                break
        if not entered:
            break
    if float(x.sum()) > bound * (1 + GAP):
        warnings.warn(f"packing: the linear program is proven within {float(x.sum()) / bound - 1:.3%} of its optimum, not within {GAP:.3%}", stacklevel=2)
    return [(float(v * scale), c) for v, c in zip(x, columns, strict=True) if v > 0], bound * scale


def plan(size: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Rows (class, first rank, ranks, per sequence, first sequence, slot) that place each rank of each class once.

    Patterns are used a whole number of times, rounded down and never beyond the demand; the few
    pieces that rounding leaves go best fit, largest first, into further sequences.
    """
    left, used, rows, sequence = demand.astype(np.int64).copy(), np.zeros(len(size), np.int64), [], 0
    for times, pattern in sorted(cutting_stock(size, demand, room)[0], key=lambda p: -p[0]):
        full = np.flatnonzero(pattern)
        n = int(min(np.floor(times + 1e-6), (left[full] // pattern[full]).min()))
        if n < 1:
            continue
        slot = 0
        for k in full[::-1]:
            rows.append((size[k], used[k], n * pattern[k], pattern[k], sequence, slot))
            used[k] += n * pattern[k]
            left[k] -= n * pattern[k]
            slot += int(pattern[k])
        sequence += n
    room_left: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by room: (sequence, next slot)
    for k in range(len(size) - 1, -1, -1):
        for _ in range(int(left[k])):
            r = next((r for r in range(int(size[k]), room) if room_left[r]), room)
            s, slot = room_left[r].pop() if r < room else (sequence, 0)
            sequence += r == room
            rows.append((size[k], used[k], 1, 1, s, slot))
            used[k] += 1
            if r - size[k]:
                room_left[r - int(size[k])].append((s, slot + 1))
    return np.array(rows, np.int64).reshape(-1, 6)


def place(placed: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, slot) of the rank-th piece of each class; placed is sorted by (class, first rank)."""
    key = placed[:, 0] << 48 | placed[:, 1]
    row = placed[np.searchsorted(key, size << 48 | rank, side="right") - 1]
    k = rank - row[:, 1]
    return row[:, 4] + k // row[:, 3], row[:, 5] + k % row[:, 3]


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Every id of every document in one piece of one sequence of at most `sequence` tokens.

    A null or empty text is its end id alone. Repeated rows and a null doc_id are packed like any
    other row, each once. An empty table gives no rows. The driver sees only the length histogram,
    at most sequence / unit classes.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=1024, mb=4)
    numbers = {"size": F.ceil(F.col("length") / F.lit(unit)).cast("long"), "number": F.monotonically_increasing_id()}
    cut = stash(pieces(docs, tokenizer, sequence).withColumns(numbers), "packing-pieces")
    hist = sorted((r["size"], r["n"]) for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect())
    size, demand = (np.array(c, np.int64) for c in zip(*hist, strict=True)) if hist else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    placed = plan(size, demand, sequence // unit) if hist else np.zeros((0, 6), np.int64)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]

    # Ranks within a class: within a bucket of the class first, then the buckets before it, so a length that a third of the documents share is no task of its own.
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Buckets go by the number of a row as it was written: rows that repeat are dealt apart, too.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    inner = W.partitionBy("size", "bucket").orderBy("doc_id", "start", "number")
    before = dealt.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = before.select("size", "bucket", (F.sum("n").over(W.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = dealt.withColumn("k", F.row_number().over(inner) - 1).join(before, ["size", "bucket"]).select(*cut.columns, (F.col("base") + F.col("k")).alias("rank"))

    def assign(batches):
        _LOADED.clear()  # a worker that has counted ids needs its words no more
        for b in batches:
            s, slot = place(placed, b.column("size").to_numpy(), b.column("rank").to_numpy())
            keep = b.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(s), pa.array(slot)], [*keep.schema.names, "sequence_id", "slot"])

    seated = ranked.mapInArrow(assign, PIECE + ", sequence_id long, slot long")
    along = W.partitionBy("sequence_id").orderBy("slot")
    return seated.withColumn("offset", F.sum("length").over(along) - F.col("length")).drop("slot")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """pack() of the whole documents table by the tokenizer of the contract, or another file; nulls, empty texts, repeated rows and an empty table as there."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
