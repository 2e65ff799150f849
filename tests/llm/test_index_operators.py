"""Lexical search, spelling variants and exact duplicates against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import lowered
from sitewise.llm import lexical_search
from sitewise.llm.exact_dedup import duplicates, trimmed
from sitewise.llm.lexical_search import search
from sitewise.llm.spelling import Grams, near_words, spelling_forms

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def order(key):
    return (key is None, key or 0)


# exact duplicates

def brute_duplicates(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return groups


def check_duplicates(got, rows):
    groups = brute_duplicates(rows)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["digest"].hex())
        ids = groups[text]
        assert (r["keep_id"], r["group_size"]) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert r["doc_id"] in ids and (not r["kept"] or r["doc_id"] == r["keep_id"])
        kept[text] += r["kept"]
    assert set(kept.values()) <= {1}


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_duplicates_at_any_number_of_counters(spark, counters):
    rng = random.Random(5)
    texts = ["Hot TEXT", "hot text", "warm É", "warm é", None, ""] + [f"t{i}" for i in range(150)]
    rows = [(i, rng.choice(texts[:2]) if rng.random() < 0.4 else rng.choice(texts)) for i in range(400)]
    check_duplicates(duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters=counters).collect(), rows)


def test_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_duplicates(duplicates(odd_docs).collect(), rows)
    assert duplicates(no_docs).count() == 0
    named = odd_docs.selectExpr("cast(doc_id as string) row", "text digest", "doc_id id")
    assert duplicates(named, key="row", text="digest").count() == len(rows)


def test_counters_lose_no_more_than_their_share():
    rng = random.Random(2)
    for k in (1, 2, 7):
        seen, held = Counter(), Counter()
        for _ in range(60):
            part = [min(int(rng.paretovariate(0.6)), 500) for _ in range(40)]
            seen.update(part)
            held.update(part)
            held = trimmed(held, k)
            assert len(held) <= k
        assert all(seen[x] - held[x] <= sum(seen.values()) / (k + 1) for x in seen)


# spelling variants

def edited(rng, word, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind < 2 else "") + word[at + (kind > 0):]


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def test_affected_grams_bound_what_an_edit_changes():
    rng = random.Random(3)
    for _ in range(3000):
        letters = "abcdé"[:rng.randrange(2, 6)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(4)]
        possible = [s[p:p + 3] for w in words for s in [Grams.marked(w), Grams.marked(edited(rng, w, letters))] for p in range(len(s) - 2)]
        grams = Grams({}, set(rng.sample(possible, rng.randrange(len(possible)))))
        a = words[0]
        b = edited(rng, a, letters)
        if len(b) < 5 or a == b:
            continue
        ga, gb = grams.cut(a), grams.cut(b)
        # a shared gram lies at the same place, or one further in the longer word
        shorter, longer = (ga, gb) if len(a) <= len(b) else (gb, ga)
        moved = (0,) if len(a) == len(b) else (0, 1)
        common = max(sum(1 for p, g in shorter if any((p + d, g) in longer for d in moved)), 0)
        for w, g in ((a, ga), (b, gb)):
            least = len(g) - grams.affected(w, g)
            assert least >= 1 and common >= least
        keys = [{k for k, more in grams.keys(w) if not more} for w in (a, b)], [{k for k, more in grams.keys(w) if more} for w in (a, b)]
        same, more = keys
        assert (same[0] & same[1]) if len(a) == len(b) else (same[0] & more[1]) if len(a) < len(b) else (same[1] & more[0])


def test_near_words_are_complete(spark):
    rng = random.Random(4)
    seeds = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    words = {w for s in seeds for w in [s, *(edited(rng, s, "abcdeé") for _ in range(6))] if len(w) >= 5} | {"aaaaa", "aaaaaa", "aaaaaaa", "baaaaa"}
    frame = spark.createDataFrame([(w, 3 + len(w)) for w in sorted(words)], "word string, n long")
    got = [(r["word"], r["near"]) for r in near_words(frame).collect()]
    want = {(a, b) for a in words for b in words if distance_is_one(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def brute_forms(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if distance_is_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_forms_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(6)
    seeds = ["harbour", "Straße", "ÉCLAIR", "letters", "lettres", "latter", "aaaaaaaa"]
    pool = [w for s in seeds for w in [s] * 40 + [s.upper()] * 3 + [v for v in (edited(rng, s, "abé") for _ in range(12)) for _ in range(rng.randrange(1, 9))]]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(40)))) for i in range(300)] + [(None, "harbour harbor, harbor;harbor"), (7, None), (8, "ab cd"), (9, "z" * 3000 + " harbour")]
    got = [tuple(r) for r in spelling_forms(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_forms(rows) and sum(r[1] is not None for r in got) > 20
    assert {r[2] for r in got if r[1] is not None} - {r[1] for r in got}  == set()
    assert set(map(tuple, spelling_forms(odd_docs).collect())) == brute_forms([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert spelling_forms(no_docs).count() == 0


def test_chains_end_at_the_root(spark):
    chain, words = "abcdefgh", []
    for k in range(6):  # each has twice the count of the one before and is one edit away from it
        chain = chain[:k] + "zyxwvu"[k] + chain[k + 1:]
        words += [chain] * (3 * 2 ** k)
    rows = [(1, " ".join(words))]
    assert set(map(tuple, spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"), drops=10 ** 9).collect())) == {
        (w, f, r, n, c, m) for w, f, r, n, c, m in _plain_forms(Counter(words))}


def _plain_forms(n):
    near = {w: [v for v in n if distance_is_one(w, v)] for w in n}
    form = {w: min((v for v in near[w] if n[v] >= 2 * n[w]), key=lambda v: (-n[v], v), default=None) for w in n}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        yield w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None


# lexical search

def brute_search(docs, items, k):
    counted = [(i, Counter(TERMS.findall(lowered(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        asked, scored = Counter(TERMS.findall(lowered(text))), []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in asked.items() if c[t])
            if score > 0:
                scored.append((-score, order(i), i))
        for rank, (score, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


@pytest.mark.parametrize("blocks, first, portion", [(3, 5, 12), (4096, 160, 200_000), (7, 1, 1)])
def test_search_equals_brute_force(spark, monkeypatch, blocks, first, portion):
    monkeypatch.setattr(lexical_search, "FIRST_DOCS", first)
    monkeypatch.setattr(lexical_search, "PORTION_TERMS", portion)
    monkeypatch.setattr(lexical_search.build_index, "__defaults__", (blocks,))
    rng = random.Random(8)
    vocabulary = ["the", "of", "ÉTÉ", "été", "x1", "größe", *(f"w{i}" for i in range(60))]
    some = [" ".join(rng.choices(vocabulary, [40, 20] + [3] * (len(vocabulary) - 2), k=rng.choice([1, 3, 10, 60]))) for _ in range(120)]
    docs = list(enumerate(rng.choice(some) if rng.random() < 0.7 else some[0] for _ in range(250))) + [(900, None), (901, ""), (902, "!? -"), (None, "w1 w2 the"), (5, "w3 w3 w3"), (903, "the " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(12)] + [(12, "the The THE"), (13, None), (14, ""), (15, "unseen"), (3, "w3 été"), (None, "w1;w2")]
    got = search(spark.createDataFrame([(i, t, 0.5, 1) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(4),
                 spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int"), 5)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 5)


def test_search_without_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([("a", "gamma alpha word")], "item_id string, text string")
    assert search(no_docs, items).count() == 0 and search(odd_docs, items.where("false")).count() == 0
    assert search(odd_docs, spark.createDataFrame([("a", "zzz")], "item_id string, text string")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert Counter(map(tuple, search(odd_docs, items).collect())) == brute_search(rows, [("a", "gamma alpha word")], 20)


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = "Alpha beta,beta été x " * 20 + "y" * 50
    assert {t.decode(): c for t, c in lexical_search.term_counts(text).items()} == Counter(TERMS.findall(lowered(text)))
