"""Similar documents by word shingles: adaptive multi-match prefixes.

Every set is ordered by the hash of its shingles. Two sets with Jaccard similarity of at least num/den share at
least m of the first (p - 1 + m) shingles of each, where p is one more than the shingles that a set can miss. A
set's prefix holds p shingles that are cheap to look up and all costly ones (of many documents, by the estimate)
that come before them; with m - 1 costly ones in it, a partner must share m shingles of the two prefixes, one of
which is cheap. So only cheap ones are looked up, and a pair is verified only if its prefixes share as many
shingles as the shorter requirement of the two says. Sets made of costly shingles nearly throughout (texts within
a group of near copies) have the whole set as prefix, and look up its p first shingles, cheap ones first. The
smaller set of a pair can miss fewer shingles than the larger one, so it needs to be found by its first few only.

Lookups of few sets give their pairs. Larger ones never do: members are compared with one chosen member, in
the one with the fewest cheap shingles, linked ones are merged, and only members still in different components
are paired. A pair is only made if the odd sketches of the two sets (for 256 hash bits, whether the number of
shingles there is odd) differ in no more bits than the sets may differ in shingles.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle

from .graphs import components
from .words import lists, mix, shingle_hashes, signed, slices, word_hashes

# One document in SAMPLE is counted to estimate how many documents hold a shingle.
SAMPLE = 16
COSTLY = 3
# Costly shingles are sent to all tasks (8 bytes each). If more are found, the cheaper of them count as cheap:
# that changes the work, not the result.
COSTLY_MOST = 1_000_000
# A lookup with more sets than this gives no pairs before its members are merged.
PAIRED = 24
SKETCH = ("s0", "s1", "s2", "s3")
# Ids sent to all tasks instead of a shuffle of the texts, 8 bytes each.
SENT_IDS = 500_000


def _needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _sets(batches, width):
    """Per batch: other columns, and the sorted distinct shingle hashes of each text."""
    for batch in slices(batches):
        words, at = word_hashes(batch.column("text"))
        yield batch, [np.unique(signed(shingle_hashes(words[at[i]:at[i + 1]], width))) for i in range(len(at) - 1)]


def _keys(sets) -> pa.Array:
    """A 64-bit key of each set (not of its order): equal sets are one class."""
    keys = []
    for s in sets:
        u = s.view(np.uint64)
        both = np.array([mix(u, 1).sum() ^ (mix(u, 2).sum() >> np.uint64(7)) ^ np.uint64(len(s))], np.uint64)
        keys.append(int(signed(mix(both, 3))[0]) if len(s) else None)
    return pa.array(keys, pa.int64())


def _costly(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of many documents, estimated on one document in SAMPLE (by hash of its text); sorted."""
    def tokens(batches):
        for batch, sets in _sets(batches, width):
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["token"])

    # equal texts are counted once
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    seen = settle(part.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= COSTLY))
    steps = seen.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(10_000).collect()
    total, least = 0, None
    for row in steps:
        total += row["n"]
        if total > COSTLY_MOST:
            break
        least = row["c"]
    if least is None:
        return np.zeros(0, np.int64)
    found = seen.where(F.col("c") >= least).select("token").toArrow()["token"].to_numpy()
    return np.sort(found)


def shingle_components(docs: DataFrame, width: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Sets of distinct ``width``-word shingles (a shorter text is one shingle); rows link when den * shared >= num *
    union. component_id is the smallest key that links reach. Null and wordless texts have no shingles and link
    with nothing; equal sets always link; rows that repeat a key each give a row; a null key takes part but names
    no component. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "text_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))  # by what a row without a key is found again
    costly = _costly(docs, width)

    def index(batches):
        flags = np.zeros(1 << 22, bool)
        flags[costly & ((1 << 22) - 1)] = True
        for batch, sets in _sets(batches, width):
            look, skip, prefix, need, cheap_n, sketches = [], [], [], [], [], []
            for s in sets:
                n = len(s)
                p = n - _needed(n, num, den) + 1 if n else 0
                hot = flags[s & ((1 << 22) - 1)]
                at = np.flatnonzero(hot)
                if len(at):
                    where = np.searchsorted(costly, s[at])
                    hot[at] = costly[np.minimum(where, len(costly) - 1)] == s[at]
                cheap = np.flatnonzero(~hot)
                if len(cheap) >= p:
                    end = int(cheap[p - 1]) + 1 if p else 0
                    prefix.append(s[:end])
                    skip.append(s[:end][hot[:end]])
                    look.append(None)  # the prefix without what is skipped
                else:
                    prefix.append(s)
                    skip.append(None)
                    look.append(np.concatenate([s[cheap], s[hot][:p - len(cheap)]]))
                need.append(len(prefix[-1]) - p + 1 if n else 0)
                cheap_n.append(len(cheap))
                sketches.append(np.packbits(np.bincount(s & 255, minlength=256) & 1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), _keys(sets), lists(look), lists(skip), lists(prefix),
                 pa.array(need, pa.int64()), pa.array(cheap_n, pa.int64()),
                 *[pa.array([k[j] for k in sketches], pa.int64()) for j in range(4)]],
                names=["doc_id", "text_id", "n", "set", "look", "skip", "prefix", "need", "cheap", *SKETCH])

    kind = dict(docs.dtypes)["doc_id"]
    rows = settle(docs.mapInArrow(index, f"doc_id {kind}, text_id long, n long, set long, look array<long>, skip array<long>, prefix array<long>, need long, cheap long, " + ", ".join(f"{k} long" for k in SKETCH)))
    # equal sets are one class from here on
    classes = settle(rows.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("first_id"), F.min("text_id").alias("text_id"), *[F.first(c).alias(c) for c in ("n", "look", "skip", "prefix", "need", "cheap", *SKETCH)]))
    # of a pair, the smaller set (by size, then key) is found by its first `first` shingles, the larger one by all
    looks = (classes.select("set", "n", F.struct(F.col("cheap") / F.col("n"), F.col("set")).alias("order"), F.posexplode(F.coalesce("look", F.array_except("prefix", "skip"))).alias("at", "token"))
             .withColumn("first", F.expr(f"at < n - (2 * {num} * n + {num + den - 1}) div {num + den} + 1")).drop("at"))
    shared = (looks.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.col("first").cast("long")).alias("firsts"),
                                         F.min("order").alias("least")).where("c > 1 and firsts > 0"))
    buckets = settle(looks.join(shared, "token").select(
        "token", "set", "n", "first", F.col("least.set").alias("center"), (F.col("c") * F.col("firsts") > PAIRED * PAIRED).alias("large"))
        .join(classes.select("set", *SKETCH), "set"))
    differ = " + ".join(f"bit_count(x.{k} ^ y.{k})" for k in SKETCH)

    def paired(x: DataFrame, condition: str) -> DataFrame:
        return (x.where("first").alias("x").join(x.alias("y"), "token").where(condition)
                .where(f"{differ} <= x.n + y.n - 2 * (((x.n + y.n) * {num} + {num + den - 1}) div {num + den})")
                .where(f"(x.n < y.n or x.n = y.n and x.set < y.set) and x.n * {den} >= y.n * {num}")
                .select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")))

    many = buckets.where("large")
    stars = many.where("set <> center").select(F.least("set", "center").alias("a"), F.greatest("set", "center").alias("b"))
    verify = _verifier(docs, classes, width, num, den)
    checked = verify(paired(buckets.where("not large"), "true").union(stars).distinct())
    links = checked.where("linked").select("a", "b")
    roots = settle(components(links, "a", "b"))
    open_ = settle(_open(many, roots))
    if not open_.isEmpty():
        rest = paired(open_, "x.root <> y.root").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        more = verify(rest).where("linked").select("a", "b")
        # linked classes stand for their components: few links are left to follow
        named = (more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
                 .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
                 .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        merged = settle(components(named, "a", "b"))
        over = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        roots = settle(over.select("node", F.coalesce("top", "root").alias("root")).union(
            merged.join(roots, "node", "left_anti").select("node", "root")))

    ids = classes.select("set", "first_id").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "root", F.coalesce("root", "set"))
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return (rows.select("doc_id", "n", "set").join(ids.join(smallest, "root").select("set", "component_id"), "set", "left")
            .select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def _open(many: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of large lookups that hold more than one component."""
    named = many.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return named.join(mixed, "token")


def _verifier(docs, classes, width, num, den):
    """A function from pairs (a, b) of classes to (a, b, linked). Prefixes are compared first, then whole sets,
    which are read from the texts of the documents that need it."""
    small = classes.select("set", "n", "prefix", "need")

    def whole(batches):
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([_keys(sets), lists(sets)], names=["set", "tokens"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs)
        if pairs.isEmpty():
            return pairs.withColumn("linked", F.lit(False))
        x = small.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"), F.col("need").alias("la"))
        y = small.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"), F.col("need").alias("lb"))
        # of the hashes up to the end of the shorter prefix, neither set may have more of its own than it can miss
        end = "if(size({0}) = {1}, {2}L, element_at({0}, -1))"
        near = settle(pairs.join(x, "a").join(y, "b")
                      .withColumn("both", F.size(F.array_intersect("pa", "pb")))
                      .withColumn("cut", F.expr(f"least({end.format('pa', 'na', 2**63 - 1)}, {end.format('pb', 'nb', 2**63 - 1)})"))
                      .withColumn("must", F.expr(f"((na + nb) * {num} + {num + den - 1}) div {num + den}"))
                      .withColumn("near", F.expr("both >= least(la, lb) and size(filter(pa, h -> h <= cut)) - both <= na - must "
                                                 "and size(filter(pb, h -> h <= cut)) - both <= nb - must"))
                      .select("a", "b", "na", "nb", "near"))
        kept = near.where("near")
        wanted = kept.select(F.col("a").alias("set")).union(kept.select(F.col("b").alias("set"))).distinct()
        first = settle(classes.join(wanted, "set", "left_semi").select("set", F.col("first_id").alias("doc_id"), "text_id"))
        nameless = settle(docs.join(first.where("doc_id is null").select("text_id"), "text_id", "left_semi").select("text").distinct())
        if first.count() <= SENT_IDS:
            first = F.broadcast(first)
        # a repeated key may bring other texts along, or the same one twice
        found = docs.join(first.select("doc_id"), "doc_id", "left_semi").select("text").union(nameless).mapInArrow(whole, "set long, tokens array<long>")
        sets = settle(found.where("set is not null").join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, "set", "left_semi"))
        a = sets.select(F.col("set").alias("a"), F.col("tokens").alias("ta"))
        b = sets.select(F.col("set").alias("b"), F.col("tokens").alias("tb"))
        same = F.size(F.array_intersect("ta", "tb"))
        linked = settle(kept.join(a, "a").join(b, "b").withColumn("same", same).select(
            "a", "b", (F.col("same") * den >= (F.col("na") + F.col("nb") - F.col("same")) * num).alias("linked"))
            .groupBy("a", "b").agg(F.max("linked").alias("linked")))
        return linked.union(near.where("not near").select("a", "b", F.lit(False).alias("linked")))

    return verify
