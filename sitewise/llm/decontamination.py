"""Find benchmark passages in documents by spaced seeds.

A mask is a window of words of which some are ignored. Hashes of the words that count are taken at every place of
every benchmark item and every document; equal ones are hits. From the first hit of a row of hits on, document and
item are laid side by side to their end, and the stretch with the best balance of equal and unequal words decides. As
masks ignore different places, a passage with some words replaced still gives hits. Only SQL functions run.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle

MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8))
# A hit with another one within so many places before it on its diagonal is part of the overlap that one measures;
# the comparison also goes so many words back.
AROUND = 48
# Items of fewer words are short: their masks ignore one place each, so that one replaced word is tolerated.
SHORT = 9
# An unequal word costs as much as this many equal ones give; in short items it costs one.
UNEQUAL = 2
# The least balance; of items with few words, this share of them, and of those whose masks ignore a place all but two.
LEAST = 10
LEAST_SHARE = 0.7
# Items with fewer words prove nothing.
SHORTEST = 5
# Scripts written without spaces: each character is a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
# Seeds that are sent to all tasks, about 60 bytes each; more of them meet the documents' in a shuffle.
SENT_SEEDS = 500_000


def _words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; of single characters in scripts without spaces."""
    text = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    spaced = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, UNSPACED, " $1 "))
    return F.transform(F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of items of ``n`` words: all places, or all but one."""
    return [tuple(range(n))] if n == SHORTEST else [tuple(p for p in range(n) if p != left) for left in range(n)]


def _seeds(masks, of: str = "w") -> str:
    """SQL for the hashes of all masks at all places, one mask after the other."""
    return "concat(" + ", ".join(
        f"if(size({of}) > {m[-1]}, transform(sequence(0, size({of}) - {m[-1] + 1}), i -> xxhash64({k}, " +
        ", ".join(f"{of}[i + {o}]" for o in m) + ")), cast(array() as array<bigint>))" for k, m in enumerate(masks)) + ")"


def _placed(frame: DataFrame, masks) -> DataFrame:
    """One row per seed: its hash, the number of its mask, and the place ``at`` of its window."""
    starts, ends = "0", []
    for m in masks:
        ends.append((starts, f"({starts} + greatest(0, size(w) - {m[-1]}))"))
        starts = ends[-1][1]
    at = F.expr("case " + " ".join(f"when _p < {hi} then _p - {lo}" for lo, hi in ends) + " end")
    mask = F.expr("case " + " ".join(f"when _p < {hi} then {k}" for k, (_, hi) in enumerate(ends)) + " end")
    # the hashes first: a generator over a plain column runs within generated code, together with the join behind it;
    # the outer form keeps the planner from testing the hashes' number, and so making them, once more in a filter
    return (frame.withColumn("_s", F.expr(_seeds(masks))).select(*frame.columns, F.posexplode_outer("_s").alias("_p", "seed"))
            .withColumn("at", at).withColumn("mask", mask).drop("_p"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, item_words, equal_words, first_word, last_word): the best overlap of each document and item.

    Places are numbered from 0 in words of the document, the last one included; overlaps are measured whole. Items
    with equal words count as the one with the smallest id; a null id is kept, and an id that comes with different
    texts gives a row for each of them. Rows that repeat a key are one document, as are rows without one. Null or
    wordless texts and items overlap with nothing, and so do items of fewer than SHORTEST words. An empty table on
    either side gives no rows.
    """
    items = settle(benchmark.select(F.col(item).alias("_item"), _words(F.col(text)).alias("w")).where(F.size("w") >= SHORTEST)
                   .groupBy("w").agg(F.min("_item").alias("_item")).withColumn("_id", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in items.where(F.size("w") < SHORT).select(F.size("w")).distinct().collect())
    masks, of = list(MASKS), []
    for n in sizes:
        of += [(len(masks) + k, n) for k in range(len(_short_masks(n)))]
        masks += _short_masks(n)
    # the masks of short items are for items of their length alone
    own = " ".join(f"when {k} then size(w) = {n}" for k, n in of)
    seeds = _placed(items, masks).where("seed is not null").where(f"case mask {own} else true end" if own else "true")
    # a hash that repeats within an item, or is shared by items, gives a hit for each place
    seeds = settle(seeds.select("seed", "_id", F.col("at").alias("item_at")).distinct())
    known = items.select("_id", "_item", F.col("w").alias("item_w"))
    worded = docs.select(F.col(key).alias("_key"), _words(F.col(text)).alias("w"))
    earlier = " or ".join("(" + " and ".join(f"w[at - d + {o}] = item_w[item_at - d + {o}]" for o in m) + ")" for m in MASKS)
    if seeds.count() <= SENT_SEEDS:
        met = _placed(worded, masks).join(F.broadcast(seeds), "seed").join(F.broadcast(known), "_id")
    else:
        # a document has a seed for each word: only places travel by seed, and words once for each item that a document hits
        worded = settle(worded.withColumn("_row", F.monotonically_increasing_id()))
        places = _placed(worded.select("_row", "w"), masks).where("seed is not null").select("_row", "seed", "at")
        places = settle(places.join(seeds, "seed").select("_row", "_id", "at", "item_at"))
        pairs = places.select("_row", "_id").distinct().join(known, "_id").join(worded, "_row")
        met = places.join(pairs, ["_row", "_id"])
    hits = (met
            .withColumn("lo", F.least("at", "item_at", F.lit(AROUND)))
            .where(f"size(item_w) < {SHORT} or lo = 0 or not exists(sequence(1, lo), d -> {earlier})")
            .withColumn("n", F.expr("least(size(w) - at, size(item_w) - item_at) + lo"))
            .withColumn("same", F.expr("zip_with(slice(w, at - lo + 1, n), slice(item_w, item_at - lo + 1, n), (x, y) -> x = y)")))
    gain = f"if(same[i], 1, if(m < {SHORT}, -1, -{UNEQUAL}))"
    best = F.expr(f"""aggregate(sequence(0, n - 1), named_struct('now', 0, 'from', 0, 'best', 0, 'lo', 0, 'hi', -1),
        (a, i) -> transform(array(named_struct('now', if(a.now > 0, a.now, 0) + {gain}, 'from', if(a.now > 0, a.from, i))), b ->
            named_struct('now', b.now, 'from', b.from, 'best', greatest(a.best, b.now), 'lo', if(b.now > a.best, b.from, a.lo),
                         'hi', if(b.now > a.best, i, a.hi)))[0])""")
    found = (hits.withColumn("m", F.size("item_w")).withColumn("b", best)
             .select("_key", "_id", "_item", "m", (F.col("at") - F.col("lo")).alias("from"), "same", "b")
             .withColumn("equal", F.expr("size(filter(slice(same, b.lo + 1, b.hi - b.lo + 1), x -> x))"))
             .select("_key", "_id", "_item", "m", F.struct(F.col("b.best").alias("balance"), "equal", (-(F.col("from") + F.col("b.lo"))).alias("first"),
                                                           (F.col("from") + F.col("b.hi")).alias("last")).alias("o")))
    # the limit comes after the aggregate: before it, the planner would work out the balance twice
    least = f"if(item_words > {SHORTEST} and item_words < {SHORT}, item_words - 2, ceil({LEAST_SHARE} * item_words))"
    return found.groupBy("_key", "_id").agg(F.first("_item").alias("_item"), F.first("m").alias("item_words"), F.max("o").alias("o")).where(
        f"o.balance >= least({LEAST}, cast({least} as int))").select(
        F.col("_key").alias(key), F.col("_item").alias(item), F.col("item_words").cast("long").alias("item_words"),
        F.col("o.equal").cast("long").alias("equal_words"), (-F.col("o.first")).cast("long").alias("first_word"),
        F.col("o.last").cast("long").alias("last_word"))
