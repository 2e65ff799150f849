"""Exact top-k inner products with a pivot-distance index.

Every vector gets one more component that brings all to the same length, so that a larger inner product is a smaller
Euclidean distance. A vector's key is its nearest pivot and its distance to it; per pivot, sorted distances are cut
into annuli, and neighbouring annuli of a pivot make a block. A query first opens the annuli nearest to it until they
hold enough vectors, which bounds the distance of its k-th neighbour; then it opens those, of all others, that the
triangle inequality leaves within that bound. A query is sent once to each block with an annulus that it opens, and
meets the block's vectors there, many queries at a time, as matrix products of bounded size.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import parallel_tasks, settle

PIVOTS = 64
PIVOT_SAMPLE = 4096
# Annuli per pivot: what is known of all of them (PIVOTS * ANNULI rows) is sent to every task.
ANNULI = 32
ANNULUS_ROWS = 256
# Vectors of a block, and queries that meet it at a time; both hold at most so many components, 8 MB.
BLOCK_ROWS = 16_384
BLOCK_CELLS = 1 << 20
# Blocks for each task, if the vectors are few: less work in each, but each query is sent more often.
BLOCKS_PER_TASK = 4
# Cells of a matrix that a worker builds for queries by annuli or by vectors, 16 MB; rows that it hands on at a time.
SLICE_CELLS = 1 << 21
ASK_ROWS = 1_024
EXACT = 2 ** 53


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow column of integer lists, filled up with zeros."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        sizes, flat = np.diff(chunk.offsets.to_numpy()), chunk.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == len(chunk) * width:
            parts.append(flat.reshape(len(chunk), width))
            continue
        out = np.zeros((len(chunk), width), np.int64)
        out[np.repeat(np.arange(len(chunk)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row that reach its ``least``; of equal ones those to the left."""
    good = scores >= least[:, None]
    many = np.flatnonzero(good.sum(1) > k)
    if len(many):
        last = np.partition(scores[many], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        good[many] &= scores[many] >= last[:, None]
    row, col = np.nonzero(good)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept]


def _products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    if longest < EXACT:  # every partial sum is an exact double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(x: np.ndarray, pivots: np.ndarray, longest: float, lifted: bool) -> np.ndarray:
    """To the pivots, which are lifted to the common length; x is lifted too unless it is a query."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    nx, np_ = (x * x).sum(1), (p * p).sum(1)
    ex = np.sqrt(np.maximum(longest - nx, 0)) if lifted else np.zeros(len(x))
    ep = np.sqrt(np.maximum(longest - np_, 0))
    squares = nx[:, None] + np_[None, :] - 2 * (x @ p.T) + (ex[:, None] - ep[None, :]) ** 2
    return np.sqrt(np.maximum(squares, 0))


def top_k(vectors: DataFrame, k: int, query_divisor: int, key: str = "vec_id", vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each key divisible by ``query_divisor``, the ``k`` other rows with the
    largest integer inner products of floor(factor * component), ties to the smaller key.

    Rows with a null key, a null vector, or a null or non-finite component take no part. Shorter vectors are filled
    up with zeros. Of rows that repeat a key, each is a candidate, and the query is the smallest of their vectors;
    none of them answers its own key. Fewer than ``k`` other rows: all. Extra columns are ignored. Inner products
    have to fit into 64 bits.
    """
    ints = settle(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("e")).where(
        "vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        .select("vec_id", F.expr(f"transform(e, x -> floor(cast(x as double) * {factor}))").alias("v")))
    stats = ints.agg(F.count("*"), F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))).first()
    out = "query_id long, vec_id long, score long"
    if not stats[0]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, width, longest = stats[0], max(1, stats[1]), float(stats[2] or 0.0)

    # pivots: each is the sampled vector that is farthest from those before it
    sample = _matrix(ints.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, rows // PIVOT_SAMPLE))) == 0)
                     .select("v").limit(2 * PIVOT_SAMPLE).toArrow()["v"], width)
    if not len(sample):
        sample = np.zeros((1, width), np.int64)
    chosen, gap = [0], _distances(sample, sample[:1], longest, True)[:, 0]
    while len(chosen) < min(PIVOTS, max(1, rows // ANNULUS_ROWS)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]], longest, True)[:, 0])
    pivots = sample[chosen]

    def keyed(batches):
        for whole in batches:
            step = max(1, SLICE_CELLS // max(width, PIVOTS))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                d = _distances(_matrix(batch.column("v"), width), pivots, longest, True)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])],
                                                 names=["vec_id", "v", "pivot", "distance"])

    index = settle(ints.mapInArrow(keyed, "vec_id long, v array<long>, pivot int, distance double"))
    # settled: both the bounds of the annuli and their rows come from the same cuts
    cuts = settle(index.groupBy("pivot").agg(F.percentile_approx("distance", [j / ANNULI for j in range(1, ANNULI)], 2000).alias("cuts"),
                                             F.count("*").alias("n")))
    index = index.join(F.broadcast(cuts), "pivot")  # a row per pivot
    steps = F.greatest(F.lit(1), F.least(F.lit(ANNULI), (F.col("n") / ANNULUS_ROWS).cast("int")))
    fine = F.expr("size(filter(cuts, c -> c < distance))")
    index = index.withColumn("annulus", (F.col("pivot") * ANNULI + (fine * steps / ANNULI).cast("int")).cast("int"))
    rings = index.groupBy("annulus").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).orderBy("annulus").toPandas()
    ring, lo, hi, held = rings["annulus"].to_numpy(), rings["lo"].to_numpy(), rings["hi"].to_numpy(), rings["n"].to_numpy()
    # blocks: neighbouring annuli of a pivot, as long as they hold few rows; a large annulus is several blocks
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // width, max(1_024, rows // (BLOCKS_PER_TASK * parallel_tasks(vectors.sparkSession)))))
    first_block, parts, filled = [], [], 0
    for i, (a, n) in enumerate(zip(ring, held)):
        new = not i or parts[-1] > 1 or n > most or filled + n > most or a // ANNULI != ring[i - 1] // ANNULI
        first_block.append((first_block[-1] + parts[-1] if i else 0) if new else first_block[-1])
        parts.append(max(1, -(-int(n) // most)))
        filled = n if new else filled + n
    starts = np.flatnonzero(np.diff(first_block, prepend=-1))  # the first annulus of each block
    block, times = np.array(first_block)[starts], np.array(parts)[starts]
    placed = vectors.sparkSession.createDataFrame([(int(a), int(f), int(p)) for a, f, p in zip(ring, first_block, parts)], "annulus int, first int, parts int")
    index = settle(index.join(F.broadcast(placed), "annulus").select(  # a row per annulus
        "vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("block")))
    queries = settle(ints.where(F.col("vec_id") % query_divisor == 0).groupBy("vec_id").agg(F.min("v").alias("q"))
                     .withColumnRenamed("vec_id", "query_id"))
    slack = 1e-6 * max(1.0, longest ** 0.5)

    def opened(first: bool):
        """Blocks that a query opens: those of the nearest annuli at first, then whatever its bound leaves."""
        def run(batches):
            for whole in batches:
                step = max(1, SLICE_CELLS // max(4 * len(ring), width))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    q = _matrix(batch.column("q"), width)
                    to = _distances(q, pivots, longest, False)[:, ring // ANNULI]
                    low = np.maximum(np.maximum(to - hi, lo - to), 0)
                    order = np.argsort(low, axis=1, kind="stable")
                    enough = np.cumsum(held[order], axis=1) - held[order] < 4 * (k + 1)
                    nearest = np.zeros(low.shape, bool)
                    np.put_along_axis(nearest, order, enough, axis=1)
                    chosen = done = np.logical_or.reduceat(nearest, starts, axis=1)
                    if not first:
                        worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)
                        bound = np.sqrt(np.maximum((q.astype(np.float64) ** 2).sum(1) + longest - 2 * worst, 0)) + slack
                        chosen = ~done & np.logical_or.reduceat(~(low > bound[:, None]), starts, axis=1)
                    who, what = np.nonzero(chosen)
                    who, what = np.repeat(who, times[what]), np.repeat(what, times[what])
                    number = block[what] + np.arange(len(what)) - np.searchsorted(who * len(block) + what, who * len(block) + what)
                    for some in range(0, len(who), ASK_ROWS):
                        who_ = pa.array(who[some:some + ASK_ROWS])
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(c).take(who_) for c in ("query_id", "q", "least")], pa.array(number[some:some + ASK_ROWS].astype(np.int32))],
                            names=["query_id", "q", "least", "block"])
        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            ids = left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(left["v"], width)[order]
            step = max(1, SLICE_CELLS // max(width, len(ids)))
            for at in range(0, right.num_rows, step):
                some = right.slice(at, step)
                own = some["query_id"].to_numpy()
                scores = _products(_matrix(some["q"], width), v, longest)
                # its own rows and what is below the bound are no answers
                lowest = np.iinfo(np.int64).min
                scores[own[:, None] == ids[None, :]] = lowest
                row, col = _best(scores, np.maximum(some["least"].fill_null(lowest).to_numpy(), lowest + 1), k)
                for out_, x in zip(found, (own[row], ids[col], scores[row, col])):
                    out_.append(x)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    fields = "query_id long, q array<long>, least long, block int"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # so many queries at a time; the vectors are repeated for each such share
    shares = max(1, -(-queries.count() // max(1, min(BLOCK_ROWS, BLOCK_CELLS // width))))
    side = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def search(asked: DataFrame, first: bool) -> DataFrame:
        ask = asked.mapInArrow(opened(first), fields).withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
        met = side.groupBy("block", "share").cogroup(ask.groupBy("block", "share")).applyInArrow(meet, out)
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = settle(search(queries.withColumns({"least": F.lit(None).cast("long")}), True))
    worst = near.groupBy("query_id").agg(F.min("score").alias("w"), F.count("*").alias("n"))
    known = F.when(F.col("n") == k, F.col("w"))  # a bound only if k were found
    asked = settle(queries.join(worst, "query_id", "left").select("query_id", "q", known.alias("least"), F.coalesce(
        known.cast("double"), F.lit(float("-inf"))).alias("worst")))
    far = search(asked, False)
    return (near.select("query_id", "vec_id", "score").union(far.select("query_id", "vec_id", "score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
