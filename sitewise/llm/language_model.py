"""Score texts with a weighted backoff automaton of word n-grams.

Every word and every pair of neighbouring words of the training texts is kept, whatever its count, so the model grows
with the corpus and no task holds it whole. Texts are cut into blocks; a block asks for its distinct words and pairs,
and its requests are sorted by hash and dealt over shards by ranges of the hash. A shard adds up the training counts of
all blocks and answers each block in the order of its request. With the answers a block builds its part of the automaton:
a state per known history, an arc per seen pair, and from each state a failure arc to the root that costs the backoff
weight. One traversal per text, left to right, carries the state and adds up the weights.

A gram is one entry in each block that holds it, so a very common one is no hot key. A shard's entries are bounded, as
their number grows with the tokens.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle

from .words import mix, signed, slices, word_hashes

# Tokens of a block, but for a slice of texts that holds more: what a task works on at a time.
BLOCK_TOKENS = 3 << 20
# Tokens whose requests make a shard; a text of t tokens asks for at most 2 t grams.
SHARD_TOKENS = 2 << 20
# A history seen c times is taken to have NOVEL * c ** GROWTH different continuations (best on a fold of training rows).
NOVEL, GROWTH = 2.0, 0.9
# The end of a text, which is also the history of its first word.
END = mix(np.zeros(1, np.uint64), 91)[0]


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, those of equal weight side by side."""
    x = np.ascontiguousarray(x, dtype="<u8")
    planes = x.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(x) else b"")


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def rising(x: np.ndarray) -> np.ndarray:
    """Steps of sorted numbers; ``np.cumsum`` gives the numbers again."""
    return np.diff(x, prepend=np.uint64(0))


class Grams:
    """Distinct words and pairs of a block, and where each token stands among them."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray):
        self.words, self.tokens = words, tokens
        self.end = int(np.searchsorted(words, END))
        self.before = np.concatenate([np.full(min(1, len(tokens)), self.end, tokens.dtype), tokens[:-1]])
        self.pairs, self.pair = np.unique(mix(words[self.before] * np.uint64(0xD6E8FEB86659FD93) + words[tokens], 2), return_inverse=True)

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.bincount(self.tokens, weights, len(self.words)).astype(np.uint64),
                np.bincount(self.pair, weights, len(self.pairs)).astype(np.uint64))


class Automaton:
    """A block's part of the automaton: ``words`` and ``pairs`` are the training counts of its grams.

    A state is a known history's number; the root is -1. Of a state, ``arc`` holds the log10 weights of its seen pairs
    (above 0 where there is none) and ``back`` that of its failure arc; ``root`` holds the weights of the root's arcs.
    The probability of w after h is (1 - b) * c(h, w) / c(h) + b * p(w), b the share of continuations that are new.
    """

    def __init__(self, grams: Grams, words: np.ndarray, pairs: np.ndarray, scale: int):
        words, pairs = words.astype(np.float64), pairs.astype(np.float64)
        alone = (words + 1) / scale
        novel = NOVEL * np.power(words, GROWTH)
        fall = np.where(words > 0, novel / np.maximum(words + novel, 1e-300), 1.0)
        history, word = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        history[grams.pair], word[grams.pair] = grams.before, grams.tokens
        seen = (1 - fall[history]) * pairs / np.maximum(words[history], 1) + fall[history] * alone[word]
        self.root = np.log10(alone)
        self.arc = np.where(pairs > 0, np.log10(np.minimum(seen, 1)), 1.0)
        self.back = [*np.log10(fall).tolist(), 0.0]
        self.state = np.where(words > 0, np.arange(len(words)), -1)
        self.grams = grams
        self.start = int(self.state[grams.end]) if len(words) else -1

    def traverse(self, lo: int, hi: int) -> float:
        """log10 probability of the tokens from ``lo`` to ``hi``, which are one text."""
        back, total, state = self.back, 0.0, self.start
        tokens = self.grams.tokens[lo:hi]
        for arc, root, leads in zip(self.arc[self.grams.pair[lo:hi]].tolist(), self.root[tokens].tolist(), self.state[tokens].tolist()):
            total += arc if arc <= 0 else back[state] + root
            state = leads
        return total


def _blocks(source: DataFrame, names: list[str]) -> DataFrame:
    """Texts as numbers of their block's words, one row per block; columns ``names`` become arrays."""
    kinds = dict(source.dtypes)

    def build(number, parts):
        hashes, sizes, learn = (np.concatenate(x) for x in list(zip(*parts))[:3])
        words, tokens = np.unique(hashes, return_inverse=True)
        columns = [pa.chunked_array([p[3].column(x) for p in parts]).combine_chunks() for x in names]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in columns]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *whole, pa.array([squeeze(rising(words))]), pa.array([squeeze(tokens)]), pa.array([squeeze(sizes)]),
             pa.array([squeeze(learn)]), pa.array([len(tokens)], pa.int64()), pa.array([int(sizes[learn > 0].sum())], pa.int64())],
            names=["block", *names, "words", "tokens", "sizes", "learn", "n", "learned"])

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        parts, held = [], 0
        for batch in slices(batches):
            hashes, at = word_hashes(batch.column("text"))
            hashes = np.insert(hashes, at[1:], END)
            parts.append((hashes, np.diff(at) + 1, batch.column("_learn").to_numpy(zero_copy_only=False).astype(np.int64), batch))
            held += len(hashes)
            if held >= BLOCK_TOKENS:
                yield build(number, parts)
                number, parts, held = number + 1, [], 0
        if held:
            yield build(number, parts)

    lists = ", ".join(f"`{x}` array<{kinds[x]}>" for x in names)
    return settle(source.mapInArrow(cut, f"block long, {lists}, words binary, tokens binary, sizes binary, learn binary, n long, learned long"))


def _grams(words: bytes, tokens: bytes) -> Grams:
    return Grams(np.cumsum(expand(words), dtype=np.uint64), expand(tokens).astype(np.int64))


def _answers(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, words, pairs, types): training counts of a block's grams in a shard, in their order there.

    types, summed over all rows, is the number of distinct training words."""

    def cuts(hashes):
        owner = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _grams(row["words"], row["tokens"])
                words, pairs = grams.counts(np.repeat(expand(row["learn"]), expand(row["sizes"]).astype(np.int64)).astype(np.float64))
                a, b = cuts(grams.words), cuts(grams.pairs)
                at = [s for s in range(shards) if a[s] < a[s + 1] or b[s] < b[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(at, np.int32)), pa.array(np.full(len(at), row["block"], np.int64)),
                     pa.array([squeeze(rising(grams.words[a[s]:a[s + 1]])) for s in at]), pa.array([squeeze(words[a[s]:a[s + 1]]) for s in at]),
                     pa.array([squeeze(rising(grams.pairs[b[s]:b[s + 1]])) for s in at]), pa.array([squeeze(pairs[b[s]:b[s + 1]]) for s in at])],
                    names=["shard", "block", "words", "word_counts", "pairs", "pair_counts"])

    def total(hashes, counts):
        """Summed counts as answers, one per request, and how many grams have any."""
        hashes = [np.cumsum(expand(x), dtype=np.uint64) for x in hashes]
        found, place = np.unique(np.concatenate(hashes), return_inverse=True)
        summed = np.zeros(len(found), np.uint64)
        np.add.at(summed, place, np.concatenate([expand(x) for x in counts]))
        ends = np.cumsum([len(x) for x in hashes])
        return [squeeze(x) for x in np.split(summed[place], ends[:-1])], int((summed > 0).sum())

    def add(group: pa.Table) -> pa.Table:
        columns = group.to_pydict()
        words, types = total(columns["words"], columns["word_counts"])
        pairs, _ = total(columns["pairs"], columns["pair_counts"])
        return pa.table({"block": group["block"], "shard": group["shard"], "words": pa.array(words), "pairs": pa.array(pairs),
                         "types": pa.array([types] + [0] * (len(words) - 1), pa.int64())})

    asked = blocks.select("block", "words", "tokens", "sizes", "learn").mapInArrow(
        ask, "shard int, block long, words binary, word_counts binary, pairs binary, pair_counts binary")
    return settle(asked.groupBy("shard").applyInArrow(add, "block long, shard int, words binary, pairs binary, types long"))


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are lower-cased words and one end per text; rows for which ``learn`` is true are learnt from. base_score adds up
    the unigrams' log10 probabilities, add-one smoothed; score those of the automaton. Null text is empty: its end alone is
    scored. Rows that repeat a key are scored each. Without training rows every token is unknown and has probability 1.
    Extra columns are ignored.
    """
    kinds = dict(docs.dtypes)
    out = [key, *carry]
    names = [f"_{i}" for i in range(len(out))]
    blocks = _blocks(docs.select(F.col(text).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("_learn"),
                                 *[F.col(x).alias(y) for x, y in zip(out, names)]), names)
    n_all, n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n_all // SHARD_TOKENS))
    answers = _answers(blocks, shards)
    scale = n + answers.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0] + 1

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = {x: block[x][0].as_py() for x in ("words", "tokens", "sizes")}
        grams = _grams(row["words"], row["tokens"])
        replies = replies.sort_by("shard").to_pydict()
        words, pairs = (np.concatenate([expand(x) for x in replies[y]]) for y in ("words", "pairs"))
        automaton = Automaton(grams, words, pairs, scale)
        sizes = expand(row["sizes"]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        known = np.add.reduceat((words > 0)[grams.tokens].astype(np.int64), at[:-1])
        base = np.add.reduceat(automaton.root[grams.tokens], at[:-1])
        scores = [automaton.traverse(lo, hi) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.table({**{y: block[x].combine_chunks().flatten() for x, y in zip(names, out)},
                         "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(sizes), n, np.int64)),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})

    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in out],
                        "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    held = blocks.select("block", *names, "words", "tokens", "sizes")
    return held.groupBy("block").cogroup(answers.select("block", "shard", "words", "pairs").groupBy("block")).applyInArrow(score, schema)
