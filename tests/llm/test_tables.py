"""Top-k search, sharding, and the pipeline."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sitewise.llm import topk_search
from sitewise.llm.sharding import kd_shards
from sitewise.llm.topk_search import top_k


def brute(rows, k, divisor):
    ints = [(i, np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64)) for i, v in rows]
    out = {}
    for q, v in ints:
        if q % divisor == 0:
            scored = sorted((-int((v * w).sum()), i) for i, w in ints if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("kind", ["clusters", "one vector", "lengths"])
def test_search_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(topk_search, "ANNULUS_ROWS", 16)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(scale=0.1, size=8)).tolist()) for i in range(300)]
    if kind == "one vector":
        rows = [(i, v if i % 3 else rows[0][1]) for i, v in rows]
    if kind == "lengths":
        rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in rows]
    got = {}
    for r in sorted(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, 10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == brute([(i, np.array(v, dtype=np.float32)) for i, v in rows], 5, 10)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    assert sorted(map(tuple, top_k(df, 5, 5).collect())) == [(0, 1, 1, 256 * 128), (0, 2, 7, 0)]
    assert top_k(df.where("false"), 5, 5).count() == 0 and top_k(df.where("vec_id = 0"), 5, 5).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(0, 60), rng.choice(["a", "b", None]), "hot" if rng.random() < 0.4 else f"s{i % 9}", rng.randrange(100)) for i in range(3000)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 8, ("lang", "source", "n_chars", "none")).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) <= 8 * 121
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    texts = {i: t for i, t, *_ in rows}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)


def test_shards_of_odd_rows(odd_docs, no_docs, spark):
    got = kd_shards(odd_docs, 3, ("lang", "source", "score", "doc_id")).collect()
    assert len(got) == odd_docs.count()
    none = next(r for r in got if r["doc_id"] == 2)
    assert (none["size"], none["text_crc32"]) == (1, 0)
    assert kd_shards(no_docs, 8, ("lang",)).count() == 0
    same = spark.createDataFrame([(1, "x")] * 64, "doc_id long, text string")
    counts = {r["shard"]: r["count"] for r in kd_shards(same, 8, ("doc_id",)).groupBy("shard").count().collect()}
    assert counts == {s: 8 for s in range(8)}


def test_pipeline_decisions(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(4)
    line = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, de = [f"the{i} and{i}" for i in range(50)], [f"der{i} und{i}" for i in range(50)]
    item = line(en, 12)
    rows = [(i, line(en if i % 2 else de, 20), "en" if i % 2 else "de") for i in range(1, 41)]
    rows += [(50, rows[4][1], "en"), (51, rows[4][1] + " more", "en"), (52, None, "en"), (53, "123 456", "de"), (54, line(de, 5) + " " + item + " " + line(de, 5), "de"),
             (55, line(en, 10) + " token = abcdef0123456789abcdef0123 " + line(en, 10), None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t) if t else 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"]: r for r in docs.collect()})
    assert sorted(set(range(1, 41)) | {50, 51, 54, 55}) == sorted(kept[0]) and kept[0][55]["lang"] == "en"
    assert set(kept[0]) - set(kept[1]) == {50, 51} and set(kept[1]) - set(kept[2]) == {54}
    assert set(kept[3]) == set(kept[2])
    masked = kept[3][55]
    assert "abcdef0123" not in masked["text"] and "[SECRET]" in masked["text"] and masked["n_chars"] == len(masked["text"])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(kept[3])


def test_stages_send_short_batches_to_workers(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        spark.conf.unset(name)
        corpus_pipeline.languages(spark, docs, str(tmp_path))
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= 1000
        spark.conf.set(name, 10)  # a smaller setting stays
        corpus_pipeline.languages(spark, docs, str(tmp_path))
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.unset(name)


def test_texts_decide_about_contamination(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"w{i}" for i in range(12))
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a clean text", "x"), (1, item, "x"), (None, item, "x"), (None, "another clean text", "x"), (2, None, "x")],
                                 "doc_id long, text string, _dropped string")
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "a clean text"), (None, "another clean text"), (2, None)}


def test_queries_travel_in_short_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 40), float(i % 7), 1.0]) for i in range(2000)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk_search, "ANNULUS_ROWS", 16)
    runs, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: runs.append((self, f)) or plain(self, f, *a, **b))
    got = top_k(df, 5, 2)
    assert got.count() == 5 * 1000
    asked = [(x, f) for x, f in runs if "q" in x.columns]
    assert len(asked) == 2
    for x, f in asked:
        table = x.toArrow().combine_chunks()
        sent = [(b.num_rows, b.column("query_id")) for b in f(table.to_batches())]
        assert max(n for n, _ in sent) <= topk_search.ASK_ROWS < 1000 * 2
        assert sum(n for n, _ in sent) <= 1000 * 64  # a query goes to a block, not to each annulus
