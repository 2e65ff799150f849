"""Ranked lexical search with a length-stratified index.

Documents of one normaliser make a stratum, cut into blocks of bounded size. A block holds, for each term, its
documents grouped by how often the term occurs: what a term adds to a score (its impact) depends on that number and
the stratum alone and is computed once for each of them. The largest impacts bound what a query can reach in a block.
Queries first visit the strata with their best bounds; what they find there bounds all others, and of the remaining
blocks only those are opened that may hold better documents.

Queries are sent to the blocks in portions of bounded size; documents are never sent to queries.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import parallel_tasks, settle

from .words import slices

# Terms: ASCII letters and digits and everything beyond ASCII. Patterns work on UTF-8 bytes, where no run ends within a character.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
PIECE = 1 << 20
BLOCK_ROWS = 4096
# Terms of queries that are sent to all tasks at once.
PORTION_TERMS = 200_000
# Documents in the strata that a query visits first.
FIRST_DOCS = 160
# Bits that tell which terms may occur in queries: terms that share a bit with one are kept needlessly, which changes no result.
FILTER_BITS = 1 << 22

INDEX = "m long, docs array<{id}>, term array<string>, tf array<long>, at array<int>, places array<int>"


def term_counts(text: str | None) -> Counter:
    raw, held, lo = (text or "").encode().lower(), Counter(), 0  # of bytes: A-Z only
    while lo < len(raw):
        hi = lo + PIECE
        if hi < len(raw):
            found = GAP.search(raw, hi)
            hi = found.start() if found else len(raw)
        held.update(TERM.findall(raw, lo, hi))
        lo = hi
    return held


def _counted(source: DataFrame, kind: str, wanted: np.ndarray | None) -> DataFrame:
    """(row, id, n, terms, tf) of each row with a term. ``wanted``: of the terms only those whose bit is set."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows, kept, sizes, terms, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = term_counts(text)
                if found:
                    rows.append(row + i)
                    kept.append(i)
                    sizes.append(sum(found.values()))
                    if wanted is not None:
                        found = {t: c for t, c in found.items() if wanted[zlib.crc32(t) & (FILTER_BITS - 1)]}
                    terms.append([t.decode() for t in found])
                    tfs.append(list(found.values()))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], names=["row", "id", "n", "terms", "tf"])
    # row numbers hold for one reading only, so they are written
    return settle(source.mapInArrow(run, f"row long, id {kind}, n long, terms array<string>, tf array<long>"))


def build_index(counted: DataFrame, kind: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of strata, from rows (row, id, n, terms, tf, m)."""
    held = counted.groupBy("m").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")]))  # null ids last: ties go to the smaller id
        lists = table["terms"].combine_chunks()
        place = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf = table["tf"].combine_chunks().flatten().to_numpy()
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((place, tf, code))
        code, tf, place = code[order], tf[order], place[order]
        new = np.flatnonzero(np.diff(code, prepend=-1).astype(bool) | np.diff(tf, prepend=-1).astype(bool))
        at = np.append(new, len(code)).astype(np.int32)

        def one(x, kind):
            return pa.array([x], pa.list_(kind))
        return pa.table({"m": table["m"].slice(0, 1), "docs": pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table["id"].combine_chunks()),
                         "term": pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), coded.dictionary.take(pa.array(code[new]))),
                         "tf": one(tf[new], pa.int64()), "at": one(at, pa.int32()), "places": one(place.astype(np.int32), pa.int32())})

    blocks = (counted.join(held, "m").withColumn("part", part).select("m", "part", "id", "terms", "tf")
              .repartition(parallel_tasks(counted.sparkSession), "m", "part"))
    return settle(blocks.groupBy("m", "part").applyInArrow(build, INDEX.format(id=kind)))


class _Queries:
    """A portion of queries: their terms with weights, one after the other."""

    def __init__(self, rows: list):
        self.item = np.array([r["row"] for r in rows], np.int64)
        names: dict[str, int] = {}
        self.term = np.array([names.setdefault(t, len(names)) for r in rows for t in r["terms"]], np.int64)
        self.weight = np.array([w for r in rows for w in r["weights"]], np.int64)
        self.start = np.cumsum([0, *(len(r["terms"]) for r in rows)])
        self.names = names


class _Block:
    """A block as a portion of queries sees it."""

    def __init__(self, queries: _Queries, m: int, term: list[str], tf: np.ndarray, at: np.ndarray):
        known = np.array([queries.names.get(t, -1) for t in term], np.int64)
        self.groups = np.flatnonzero(known >= 0)
        gain = 1_000_000_000 * tf // (1000 * tf + 12 * m)  # one impact per number of occurrences
        self.gain, self.at, size = gain, at, len(queries.names)
        # groups of a term follow each other with rising tf: the last has the largest impact
        self.first, self.last = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.first[known[self.groups][::-1]] = self.groups[::-1]
        self.last[known[self.groups]] = self.groups
        self.queries = queries
        top = np.where(self.last >= 0, gain[self.last] if len(gain) else 0, 0)
        self.bounds = np.add.reduceat(queries.weight * top[queries.term], queries.start[:-1])

    def best(self, q: int, places: np.ndarray, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best places of the block for a query, and their scores."""
        scores = np.zeros(docs, np.int64)
        own = slice(self.queries.start[q], self.queries.start[q + 1])
        for t, w in zip(self.queries.term[own], self.queries.weight[own]):
            if self.last[t] >= 0:
                for g in range(self.first[t], self.last[t] + 1):
                    scores[places[self.at[g]:self.at[g + 1]]] += w * self.gain[g]
        found = np.flatnonzero(scores)
        found = found[np.argsort(-scores[found], kind="stable")[:k]]
        return found, scores[found]


def _blocks(batches, queries, names):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {x: batch.column(x)[i] for x in names}
            yield _Block(queries, row["m"].as_py(), row["term"].as_py(), row["tf"].values.to_numpy(), row["at"].values.to_numpy()), row


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``k`` documents with the highest scores above 0 for each row of ``items``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; weights, normalisers and
    scores are integers, as the code below states. Equal scores rank by ascending key, null keys last. Null and empty
    texts have no terms: such items get no rows, such documents count nowhere. Rows that repeat a key are documents,
    rows that repeat an item id are items, each by itself. Fewer than ``k`` documents with a score: all of them.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    asked = _counted(items.select(F.col(item).alias("id"), F.col(item_text).cast("string").alias("text")), item_kind, None)
    bit = F.expr(f"crc32(cast(t as binary)) % {FILTER_BITS}")
    bits = [r["b"] for r in asked.select(F.explode("terms").alias("t")).select(bit.alias("b")).distinct().toLocalIterator()]
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[bits] = True
    counted = _counted(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), kind, wanted)
    total, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = f"row long, id {kind}, score long"
    if not total or not bits:
        return spark.createDataFrame([], f"{item} {item_kind}, rank int, {key} {kind}, score long")
    index = build_index(counted.withColumn("m", F.expr(f"75 + (25 * n * {total}) div {length}")), kind)

    def frequencies(batches):
        held: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("at")[i].values.to_numpy()
                for t, c in zip(batch.column("term")[i].as_py(), np.diff(at).tolist()):
                    held[t] += c
            if len(held) > PORTION_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])

    df = index.select("term", "at").mapInArrow(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    terms = asked.select("row", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.tf").alias("times"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = settle(terms.join(df, "term").withColumn("w", F.col("times") * weight).where("w > 0").groupBy("row")
                      .agg(F.collect_list(F.struct("term", "w")).alias("t")).select("row", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")))
    many = weighted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    portions = max(1, -(-many // PORTION_TERMS))

    found = None
    for portion in range(portions):
        rows = weighted.where(F.pmod(F.xxhash64("row"), F.lit(portions)) == portion).collect()
        if rows:
            part = _search_portion(index, _Queries(rows), k, schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("id").alias("item")), "row").select(
        F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def _search_portion(index: DataFrame, queries: _Queries, k: int, schema: str) -> DataFrame:
    """(row, id, score): the best documents of every query of a portion, and some that are not."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(queries)  # at most about PORTION_TERMS terms

    def bounds(batches):
        for block, row in _blocks(batches, sent.value, ("m", "docs", "term", "tf", "at")):
            q = np.flatnonzero(block.bounds)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), row["m"].as_py())), pa.array(block.bounds[q]), pa.array(np.full(len(q), len(row["docs"])))],
                                             names=["q", "m", "bound", "docs"])

    strata = (index.withColumn("docs", F.expr("transform(docs, d -> 0)")).drop("places").mapInArrow(bounds, "q long, m long, bound long, docs long")
              .groupBy("q", "m").agg(F.max("bound").alias("bound"), F.sum("docs").alias("docs")))
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    # each stratum has a document, so a query has at most FIRST_DOCS of them
    first: dict[int, list[int]] = {}
    for r in strata.withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))).where(F.col("before") < FIRST_DOCS).select("q", "m").toLocalIterator():
        first.setdefault(r["m"], []).append(r["q"])

    def visit(least: np.ndarray | None):
        """First visits, or without those all blocks that may hold a document of at least the known score."""
        def run(batches):
            queries = sent.value
            best = np.zeros(len(queries.item), np.int64) if least is None else least.copy()
            held: dict[int, np.ndarray] = {}
            for block, row in _blocks(batches, queries, ("m", "docs", "term", "tf", "at", "places")):
                early = first.get(row["m"].as_py(), [])
                if least is None:
                    chosen = early
                else:
                    open_ = block.bounds >= np.maximum(best, 1)
                    open_[early] = False
                    chosen = np.flatnonzero(open_).tolist()
                out, places, ids = ([], [], []), row["places"].values.to_numpy(), row["docs"].values
                for q in chosen:
                    if block.bounds[q] >= max(best[q], 1):
                        found, scores = block.best(q, places, len(ids), k)
                        found, scores = found[scores >= best[q]], scores[scores >= best[q]]
                        if len(found):
                            out[0].append(np.full(len(found), queries.item[q]))
                            out[1].append(found)
                            out[2].append(scores)
                            # the k-th best so far bounds what follows
                            held[q] = -np.sort(-np.append(held.get(q, scores[:0]), scores))[:k]
                            if len(held[q]) == k:
                                best[q] = max(best[q], held[q][-1])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), ids.take(pa.array(np.concatenate(out[1]))), pa.array(np.concatenate(out[2]))],
                                                     names=["row", "id", "score"])
        return run

    near = settle(index.where(F.col("m").isin(sorted(first))).mapInArrow(visit(None), schema))
    worst = Window.partitionBy("row").orderBy(F.desc("score"))
    known = {r["row"]: r["score"] for r in near.withColumn("rank", F.row_number().over(worst)).where(F.col("rank") == k).select("row", "score").toLocalIterator()}
    least = np.array([known.get(int(i), 0) for i in queries.item], np.int64)
    far = index.repartitionByRange(parallel_tasks(spark), "m").sortWithinPartitions("m").mapInArrow(visit(least), schema)
    return near.union(far)
