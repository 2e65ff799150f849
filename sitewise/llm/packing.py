"""Pack token sequences of documents by the sum-of-squares rule.

Each piece goes to the open bin after which the sum, over all residual gaps, of the squared counts of open bins
with that gap is smallest; ties go to the tighter bin. As all pieces are known and the longest come first, a new
bin is opened only where no open one has room. Blocks of pieces are packed in parallel. Bins that a block could not fill are dissolved and packed again with those of
other blocks, in half as many blocks or fewer each time, so that only the last block leaves half-filled bins. Pieces
that do not become fewer that fast are placed all together by the numbers of their lengths, whole runs of equal
lengths at a time, and rows find their place by their rank within their length.
"""
from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle

from .words import slices

BLOCK_PIECES = 20_000
# A bin whose gap is at most this share of it is not dissolved.
FULL_SHARE = 1 / 256
# Bytes of words and ids, about, that a worker keeps: the words used last in one half, older ones in the other.
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 200  # of an entry besides its characters and ids
LONGEST_KEPT = 64  # longer stretches are never kept
_END_MARKS = ".,;:!?\"()[]{}|#*-_/\\=+<>~$%&@^"
# Marks at the end of a word of these letters are stretches of their own to the tokenizer.
_ENDING = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[" + re.escape(_END_MARKS) + r"]+(?:\s|$))")
_encoders: dict = {}


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) of stretches without white space, which the tokenizer never joins."""

    def __init__(self, path, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        self.older: dict[str, bytes] = {}
        self.room = cache_bytes // 2  # what is left of this half
        self.half = cache_bytes // 2
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST_KEPT:
            self.room -= ENTRY_BYTES + 2 * len(word) + len(ids)
            if self.room < 0:  # the older half goes, this one takes its place
                self.older = dict(self)
                self.clear()
                self.room = self.half
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            return self.keep(word, ids)
        latin = word.isascii() or max(word) < "ɐ"
        plain = word.lower() if latin else word
        stem = word.rstrip(_END_MARKS)
        if plain != word:
            ids = self[plain]
        elif stem and stem != word and stem[-1].isalpha():
            ids = self[stem] + self[word[len(stem):]]
        elif latin and word.isalpha() and "̇" not in word:  # one stretch of letters that the normalizer leaves alone
            letters = word.encode().decode("latin-1").translate(self.alphabet)
            ids = np.asarray([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        else:
            ids = self.whole(word)
        return self.keep(word, ids)

    def encode(self, text: str) -> bytes:
        # special tokens may hold spaces or touch words, and these control characters are no white space to the tokenizer
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        if text.isascii() or max(text) < "ɐ":  # so that variants are no entries of their own
            text = _ENDING.sub(" ", text.lower())
        return b"".join(map(self.__getitem__, text.split()))


def _encoder(path: str) -> _Words:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = _Words(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``size`` ids.

    ``tokenizer`` is the path of a tokenizer file that splits at white space and lower-cases; every executor reads
    it. A null text is empty: one piece that holds only ``end_id``. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def cut(batches):
        encoder = _encoder(tokenizer)
        tail = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                ids = encoder.encode(value.as_py() or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("doc_id", key)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece in the order given, and the gap that each bin is left with."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap; full ones are not open
    open_bins: dict[int, list[int]] = {}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    gaps: list[int] = []
    for i, s in enumerate(lengths.tolist()):
        held = count[s:size]
        change = np.where(held > 0, 2 * (count[:size - s] - held) + 2, np.iinfo(np.int64).max)
        if len(change) and held[0]:
            change[0] = 1 - 2 * held[0]  # a filled bin leaves the sum
        best = int(change.argmin()) if len(change) else 0
        if len(change) and held[best]:
            gap = best + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, len(gaps)
            gaps.append(size)
        bins[i], offsets[i] = b, size - gap
        gaps[b] = gap - s
        if gap > s:
            count[gap - s] += 1
            open_bins.setdefault(gap - s, []).append(b)
    return bins, offsets, np.asarray(gaps, np.int64)


def _filler(size, length, order, columns, level, tolerance):
    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, *order], ascending=[False] + [True] * len(order), kind="stable")
        bins, offsets, gaps = sum_of_squares(frame[length].to_numpy(), size)
        out = frame[columns].copy()
        out["sequence_id"] = (level << 56) + (int(frame["_block"].iloc[0]) << 24) + bins
        out["offset"] = offsets
        out["_open"] = gaps[bins] > tolerance
        return out
    return fill


def runs_of_lengths(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of equal lengths placed by the sum-of-squares rule, longest first: (length, rank, n, bin, offset, per_bin).

    The n pieces of a length from that rank on lie in bins that follow each other, per_bin in each, from that offset
    on. At most an eighth of the open bins of a gap is filled before the rule is asked again, so that the work grows
    with the lengths and the logarithm of their numbers.
    """
    count = np.zeros(size + 1, np.int64)
    held_bins: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            count[gap] += n
            held_bins.setdefault(gap, []).append((first, n))

    for s in sorted(counts, reverse=True):
        rank, left = 0, counts[s]
        while left:
            held = count[s:size]
            change = np.where(held > 0, 2 * (count[:size - s] - held) + 2, np.iinfo(np.int64).max)
            if len(change) and held[0]:
                change[0] = 1 - 2 * held[0]
            best = int(change.argmin()) if len(change) else 0
            if len(change) and held[best]:
                gap = best + s
                n = min(left, max(1, int(held[best]) // 8))
                left -= n
                count[gap] -= n
                while n:
                    first, there = held_bins[gap].pop()
                    taken = min(n, there)
                    if there > taken:
                        held_bins[gap].append((first + taken, there - taken))
                    runs.append((s, rank, taken, first, size - gap, 1))
                    leave(gap - s, first, taken)
                    rank, n = rank + taken, n - taken
                continue
            for per in (size // s, left % (size // s)):
                n = left // per if per else 0
                if n:
                    runs.append((s, rank, n * per, bins, 0, per))
                    leave(size - per * s, bins, n)
                    bins, rank, left = bins + n, rank + n * per, left - n * per
    return runs


def _by_lengths(rest: DataFrame, rows: int, size: int, length: str, order: tuple[str, ...], level: int) -> DataFrame:
    """All of ``rest`` placed by the numbers of its lengths. Tasks hold about BLOCK_PIECES rows, whatever is equal."""
    columns, fields = rest.columns, rest.schema.simpleString()[len("struct<"):-1]
    numbered = settle(rest.withColumn("_id", F.monotonically_increasing_id()))
    sliced = settle(numbered.repartitionByRange(-(-rows // BLOCK_PIECES), length, *order, "_id").withColumn("_slice", F.spark_partition_id()))
    # a row per slice and one per length at most, as slices follow each other
    counts, before = {}, {}
    for r in sliced.groupBy(length, "_slice").agg(F.count("*").alias("n")).orderBy(length, "_slice").collect():
        before[r["_slice"], r[length]] = counts.get(r[length], 0)
        counts[r[length]] = counts.get(r[length], 0) + r["n"]
    runs = np.asarray(sorted(runs_of_lengths(counts, size)), np.int64)
    starts = (runs[:, 0] << 44) + runs[:, 1]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, *order, "_id"], kind="stable")
        lengths = frame[length].to_numpy()
        own, first, each = np.unique(lengths, return_index=True, return_counts=True)
        part = int(frame["_slice"].iloc[0])
        rank = np.arange(len(lengths)) + np.repeat([before[part, n] for n in own.tolist()] - first, each)
        run = runs[np.searchsorted(starts, (lengths << 44) + rank, "right") - 1]
        later = rank - run[:, 1]
        out = frame[columns].copy()
        out["sequence_id"] = (level << 56) + run[:, 3] + later // run[:, 5]
        out["offset"] = run[:, 4] + later % run[:, 5] * lengths
        return out
    return settle(sliced.groupBy("_slice").applyInPandas(place, f"{fields}, sequence_id long, offset long"))


def pack(pieces: DataFrame, size: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset: at most ``size`` in each sequence, gapless from 0.

    Lengths are from 1 to ``size``; ``order`` breaks ties among equal lengths (rows that agree in it too may swap
    places). Every row is placed. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    rest = settle(pieces)
    fields = rest.schema.simpleString()[len("struct<"):-1]
    columns = rest.columns
    tolerance = int(size * FULL_SHARE)
    done, level, before = [], 0, None
    while True:
        rows = rest.count()
        blocks = max(1, -(-rows // BLOCK_PIECES))
        if before is not None and blocks > max(1, before // 2):
            done.append(_by_lengths(rest, rows, size, length, order, level))
            break
        last, before = blocks == 1, blocks

        packed = settle(rest.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(level)), F.lit(blocks)))
                        .groupBy("_block").applyInPandas(_filler(size, length, order, columns, level, size if last else tolerance), f"{fields}, sequence_id long, offset long, _open boolean"))
        done.append(packed.where("not _open").drop("_open"))
        if last:
            break
        rest = settle(packed.where("_open").select(*columns))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
