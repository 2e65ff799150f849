"""Similarity join and connected components against brute force."""
import random

import pytest
from conftest_llm import UnionFind, words

from sitewise.llm.graphs import components
from sitewise.llm import ngram_join
from sitewise.llm.ngram_join import shingle_components


def brute(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    found = UnionFind(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                found.join(a, b)
    return {i: (len(sets[i]), found.find(i)) for i in ids}


def near_copies(seed):
    """Groups of copies with a few changed words, texts of common passages, and texts of one or two words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(4)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 25, 60, 150]))] + rng.choice(passages) * (group % 3)
        for _ in range(rng.choice([1, 2, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [" ".join(p) for p in passages] + [" ".join(p + passages[0]) for p in passages] + ["one", "One", "two words", "TWO words ", "", None]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,width,num,den", [(1, 3, 90, 100), (2, 5, 80, 100)])
def test_components_equal_brute_force(spark, monkeypatch, seed, width, num, den):
    monkeypatch.setattr(ngram_join, "PAIRED", 3)
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    rows = near_copies(seed)
    got = shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, num, den)


def test_rows_without_a_key_link(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-1] + ["y"]), " ".join(reversed(base)), " ".join(reversed(base[1:]))]
    docs = spark.createDataFrame(list(zip([9, 7, None, None, None], texts)) + [(None, texts[2])] * 3, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in shingle_components(docs, 3, 90, 100).collect()}
    assert got == {(9, 7), (7, 7), (None, 7), (None, None)}
    # a link between texts of which the only one between has no key
    docs = spark.createDataFrame([(9, " ".join(base)), (None, " ".join(base[:-2])), (7, " ".join(base[2:-2]))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_components(docs, 3, 95, 100).collect()}
    assert got == {9: 7, None: 7, 7: 7}


def test_odd_rows(odd_docs, no_docs):
    got = shingle_components(odd_docs, 3, 90, 100).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == odd_docs.count()
    assert by[1] == by[5] == (3, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[8] == (1, 8) and by[9] == (1, 9)
    assert shingle_components(no_docs, 3, 90, 100).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 5)], "x long, y long")
    got = {r["node"]: r["root"] for r in components(chain, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
