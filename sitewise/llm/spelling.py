"""Group spelling variants with an index of variable-length grams.

Grams have two or three characters of a word between two marks. Three-character grams are in the dictionary if they
are frequent themselves and continue a frequent two-character gram; a word is cut into the longest grams at each
place that no earlier gram covers. One edit changes a number of a word's grams that is bounded word by word, so two
near words share all but so many of the grams of each. It is enough to merge the lists of each word's rarest grams:
as many as the bound, and one or two more. What meets there is verified.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.session import parallel_tasks, settle

from .words import slices

PIECE = 1 << 20
# Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
# A gram of two characters with more than this share of all grams is continued to three characters, of which those
# with more than KEPT_SHARE are kept: at most 1 / KEPT_SHARE entries, which are sent to all tasks.
SPLIT_SHARE = 5e-4
KEPT_SHARE = 2e-5


def runs(text: str, pattern: re.Pattern, gap: re.Pattern):
    """Lists of all matches, of about a piece of a text each; no piece ends within a match."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            found = gap.search(text, hi)
            hi = found.start() if found else len(text)
        yield pattern.findall(text, lo, hi)
        lo = hi


def word_counts(docs: DataFrame, least_length: int, least_count: int, drops: int, key: str, text: str) -> DataFrame:
    """(word, n). Every ``drops``-th pair of document and word, by crc32, loses one code point."""
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)  # shorter runs can't become words
    gap = re.compile("[^a-zÀ-ÿ]")

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches):
            for own, whole in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                seen: Counter = Counter()
                for part in runs((whole or "").encode().lower().decode(), pattern, gap):  # of bytes: A-Z only
                    seen.update(part)
                start = zlib.crc32(f"{own or ''}:".encode())
                for run, n in seen.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % drops == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    source = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return (source.mapInArrow(count, "word string, n long").where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


class Grams:
    """The gram dictionary: kept three-character grams and how often grams occur, which gives their order."""

    def __init__(self, counts: dict[str, int], kept: set[str]):
        self.kept = kept
        self.counts = counts
        self.heads = {g[:2] for g in kept}
        self.tails = {g[1:] for g in kept}

    @staticmethod
    def marked(word: str) -> str:
        return f"^{word}$"

    def cut(self, word: str) -> list[tuple[int, str]]:
        """(place, gram): at each place the longest gram, unless it lies within an earlier one."""
        s, out, last = self.marked(word), [], 0
        for p in range(len(s) - 1):
            end = p + 3 if s[p:p + 3] in self.kept and p + 3 <= len(s) else p + 2
            if end > last:
                out.append((p, s[p:end]))
                last = end
        return out

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most of a word's grams that one inserted, deleted or replaced character can change.

        Besides those over the edited place, a two-character gram beside it may be covered by a new longer gram,
        if the dictionary has one that begins (ends) with it."""
        size = len(word) + 2
        over, across = np.zeros(size + 2, np.int64), np.zeros(size + 2, np.int64)
        before, after = np.zeros(size + 3, np.int64), np.zeros(size + 3, np.int64)
        for p, g in grams:
            end = p + len(g)
            over[p] += 1
            over[end] -= 1
            across[p + 1] += 1
            across[end] -= 1
            if len(g) == 2:
                before[end] = g in self.heads
                after[p] = g in self.tails
        over, across = over.cumsum(), across.cumsum()
        at = np.arange(1, size - 1)
        gaps = np.arange(1, size)
        return int(max((over[at] + before[at] + after[at + 1]).max(), (across[gaps] + before[gaps] + after[gaps]).max()))

    def rarest(self, grams: list[tuple[int, str]], many: int) -> list[tuple[int, str]]:
        return sorted(grams, key=lambda x: (self.counts.get(x[1], 0), x[1], x[0]))[:many]

    def keys(self, word: str):
        """(key, longer): what the word is looked up by, among words of its length and, as the longer one, among
        words that have one character less.

        A near word shares at least len(grams) - affected grams, at the same place or, in the longer word, one
        later. If that is two or more, both words have two of them among their first affected + 2."""
        grams = self.cut(word)
        changed = self.affected(word, grams)
        size = len(word)
        two = sorted(self.rarest(grams, changed + 2))
        if len(grams) - changed < 2:
            for p, g in self.rarest(grams, changed + 1):
                yield f"{size}:{p}{g}", False
                yield f"{size - 1}:{p}{g}", True
                yield f"{size - 1}:{p - 1}{g}", True
        for i, (p, g) in enumerate(two):
            for q, f in two[i + 1:]:
                yield f"{size}:{p}{g}:{q}{f}", False
                yield f"{size - 1}:{p}{g}:{q}{f}", True
                yield f"{size - 1}:{p}{g}:{q - 1}{f}", True
                yield f"{size - 1}:{p - 1}{g}:{q - 1}{f}", True


def gram_dictionary(words: DataFrame, split_share: float = SPLIT_SHARE, kept_share: float = KEPT_SHARE) -> Grams:
    """From all words: letters are few, so the grams of two characters are; those of three are cut by their share."""
    def count(batches):
        for batch in slices(batches):
            held: Counter = Counter()
            for word in batch.column("word").to_pylist():
                s = Grams.marked(word)
                held.update(s[p:p + 2] for p in range(len(s) - 1))
                held.update(s[p:p + 3] for p in range(len(s) - 2))
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "c"])

    counts = settle(words.select("word").mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    total = counts.where(F.char_length("gram") == 2).agg(F.sum("c")).first()[0] or 0
    two = {r["gram"]: r["c"] for r in counts.where(F.char_length("gram") == 2).toLocalIterator()}
    three = {r["gram"]: r["c"] for r in counts.where((F.char_length("gram") == 3) & (F.col("c") > kept_share * total)).toLocalIterator()}
    kept = {g for g in three if two[g[:2]] > split_share * total}
    return Grams(two | three, kept)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (word, n) that differ by one edit."""
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(gram_dictionary(words))  # bounded by the shares and the letters

    def keyed(batches):
        for batch in slices(batches):
            keys, longer, word, n = [], [], [], []
            for w, c in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for key, more in grams.value.keys(w):
                    keys.append(key)
                    longer.append(more)
                    word.append(w)
                    n.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(longer, pa.bool_()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                                             names=["key", "longer", "word", "n"])

    lists = settle(words.repartition(parallel_tasks(spark)).mapInArrow(keyed, "key string, longer boolean, word string, n long"))
    left = lists.where("not longer").select("key", "word", "n")
    right = lists.select("key", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = (left.join(right, "key").where("(longer or word < near) and levenshtein(word, near, 1) = 1")
             .select("word", "n", "near", "near_n").distinct())
    pairs = settle(pairs)
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def spelling_forms(docs: DataFrame, least_length: int = 5, least_count: int = 3, drops: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``.

    Words are runs of a-z and U+00C0 to U+00FF after lower-casing A-Z, with at least ``least_length`` code points and
    ``least_count`` occurrences; one in ``drops`` (by crc32 of key and run) loses a code point first. Near words
    differ by one inserted, deleted or replaced code point. The form is the near word with most occurrences (ties:
    the smallest), if it has at least twice as many as the word; the root ends the chain of forms. Null texts have no
    words, a null key counts as an empty text, rows that repeat a key count each. Extra columns are ignored.
    ``least_length`` must be at least 5: shorter words need not share a gram.
    """
    if least_length < 5:
        raise ValueError("Words of fewer than five characters need not share a gram with their near words")
    words = settle(word_counts(docs, least_length, least_count, drops, key, text))
    best = near_words(words).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    best = settle(best.select("word", "n_near", F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
                              (-F.col("best.less")).alias("best_n")))
    # chains at least double n with each form, so they are short; each round doubles the way that is known
    up = best.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settle(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return words.join(best, "word", "left").join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
