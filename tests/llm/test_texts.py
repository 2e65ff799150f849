"""Word hashes, packing, language model, language ID, toxicity."""
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import words
from pyspark.sql import functions as F

from sitewise.llm import chars, language_id, language_model, toxicity
from sitewise.llm import words as hashing
from sitewise.llm.language_model import Automaton, Grams, expand, score_texts, squeeze
from sitewise.llm.packing import _Words, pack, sum_of_squares, token_pieces


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_hashes_follow_the_words(monkeypatch):
    texts = ["One two  THREE\n", None, "", "two", " é ÉÉ three", "x" * 300 + " y", "a b " * 50]
    for piece in (4 << 20, 7):
        monkeypatch.setattr(hashing, "PIECE_BYTES", piece)
        hashes, at = hashing.word_hashes(pa.array(texts))
        flat = [w for t in texts for w in words(t)]
        assert list(np.diff(at)) == [len(words(t)) for t in texts]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    sliced, _ = hashing.word_hashes(pa.array(texts).slice(3, 2))
    assert sliced.tolist() == hashes.tolist()[at[3]:at[5]]


def test_words_are_encoded_as_the_whole_text(tokenizer):
    encoder = _Words(tokenizer)
    for text in ("It's THE Erste, ßtraße!! don't ÀÉ 12a3 --x--", "a b c\td\r\n", "Á Å İx", "odd\x1ctext", "<|endoftext|> x", "mañana... (sí), 'quoted'", "日本 語", ""):
        assert encoder.encode(text) == encoder.whole(text), text


@pytest.mark.parametrize("seed", [0, 1])
def test_bins_are_filled_gapless_and_few(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted((min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(800)), reverse=True))
    bins, offsets, gaps = sum_of_squares(sizes, 64)
    for b in range(len(gaps)):
        mine = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
        ends = np.cumsum([s for _, s in mine])
        assert [o for o, _ in mine] == [0, *ends[:-1]] and ends[-1] + gaps[b] == 64
    assert len(gaps) <= -(-sizes.sum() // 64) + 1


def test_word_cache_is_bounded_by_bytes(tokenizer):
    """Long stretches are not kept, the older half goes, and ids stay those of the tokenizer."""
    encoder = _Words(tokenizer, cache_bytes=60_000)
    texts = ["".join(chr(0x4E00 + (i * 37 + j) % 4000) for j in range(3000)) for i in range(20)]
    texts += [" ".join(f"Wort{i}x{j}, WORT{i}x{j}." for j in range(40)) for i in range(60)] + ["Straße, ÉTÉ! (été) a.b, word... x²,"] * 2
    for text in texts:
        assert encoder.encode(text) == encoder.whole(text)
        held = [{**encoder}, encoder.older]
        assert all(sum(len(w) + len(ids) for w, ids in d.items()) < 30_000 and max(map(len, d), default=0) <= 64 for d in held)
    assert encoder.older and encoder.encode("") == b""


def test_packing_whole(spark, odd_docs, no_docs, tokenizer):
    pieces = token_pieces(odd_docs, tokenizer, size=64)
    rows = pack(pieces, size=64).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 1 and len(rows) == pieces.count()
    encoder = _Words(tokenizer)
    for doc_id, text in ((1, "alpha beta gamma delta epsilon"), (8, "word " * 30_000), (2, "")):
        ids = encoder.whole(text) + b"\0\0\0\0"
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == [(s, min(64, len(ids) // 4 - s)) for s in range(0, len(ids) // 4, 64)]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[4 * r["start"]:4 * (r["start"] + r["length"])]) for r in mine]
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(ends.values()) // 64) + 1
    assert pack(token_pieces(no_docs, tokenizer)).count() == 0


def test_blocks_are_packed_again(spark, monkeypatch):
    from sitewise.llm import packing
    monkeypatch.setattr(packing, "BLOCK_PIECES", 150)
    rng = random.Random(3)
    rows = [(i, 0, rng.randrange(1, 101)) for i in range(500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), size=100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i, n) for i, _, n in rows)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 100 and len(filled) <= 1.06 * sum(n for *_, n in rows) / 100


def test_pieces_that_fill_no_bin_stay_in_small_tasks(spark, monkeypatch):
    from sitewise.llm import packing
    filler = packing._filler

    def watched(*args):
        fill = filler(*args)

        def small(frame):
            assert len(frame) <= 130, len(frame)
            return fill(frame)
        return small

    monkeypatch.setattr(packing, "BLOCK_PIECES", 80)
    monkeypatch.setattr(packing, "_filler", watched)
    rng = random.Random(4)
    rows = [(i, 0, 75) for i in range(500)] + [(i, 0, rng.choice((60, 70, 90, 12))) for i in range(500, 640)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), size=100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((i, n) for i, _, n in rows)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    large = sum(n > 50 for *_, n in rows)
    assert max(filled.values()) <= 100 and len(filled) == large


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_of_lengths_are_gapless_and_few(seed):
    from sitewise.llm.packing import runs_of_lengths
    rng = random.Random(seed)
    counts = {s: rng.randrange(1, 60) for s in range(1, 65)}
    parts, ranks = {}, {s: [] for s in counts}
    for s, rank, n, first, offset, per in runs_of_lengths(counts, 64):
        for j in range(n):
            ranks[s].append(rank + j)
            parts.setdefault(first + j // per, []).append((offset + j % per * s, s))
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items())
    for mine in parts.values():
        ends = np.cumsum([s for _, s in sorted(mine)])
        assert [o for o, _ in sorted(mine)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(parts) <= -(-sum(s * n for s, n in counts.items()) // 64) * 1.02 + 1


def test_numbers_are_squeezed_and_expanded():
    for x in ([], [0], [5, 1, 2 ** 64 - 1, 0], range(1000)):
        assert expand(squeeze(np.array(x, np.uint64))).tolist() == list(x)


def test_automaton_is_a_distribution():
    vocabulary = np.sort(np.append(np.arange(10, 15, dtype=np.uint64), language_model.END))
    end = int(np.searchsorted(vocabulary, language_model.END))
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, 4, size), end) for size in (0, 3, 9, 30)]
    every = [np.array([a, b, end]) for a in range(6) for b in range(6) if end not in (a, b)]  # each pair once, not learnt
    grams = Grams(vocabulary, np.concatenate(texts + every))
    learnt = np.concatenate([np.ones(len(np.concatenate(texts))), np.zeros(len(np.concatenate(every)))])
    counts, pairs = grams.counts(learnt)
    scale = int(counts.sum() + (counts > 0).sum() + 1)
    model = Automaton(grams, counts, pairs, scale)
    place = {(a, b): j for a, b, j in zip(grams.before.tolist(), grams.tokens.tolist(), grams.pair.tolist())}
    for history in range(5):
        state = model.state[history]
        step = lambda w: model.arc[place[history, w]] if model.arc[place[history, w]] <= 0 else model.back[state] + model.root[w]
        known = sum(10 ** step(w) for w in range(6) if counts[w] and (history, w) in place)
        other = 10 ** model.back[state] / scale  # all words that the training texts lack
        assert known + other == pytest.approx(1.0)


@pytest.mark.parametrize("block", [3 << 20, 4])
def test_scores_equal_plain_counts(spark, odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
    docs = odd_docs.where("doc_id is not null").repartition(3)
    rows = score_texts(docs, F.col("doc_id") != 6, carry=("source", "length")).collect()
    assert len(rows) == 10 and {(r["doc_id"], r["source"], r["length"]) for r in rows} == {tuple(r) for r in docs.select("doc_id", "source", "length").collect()}
    tokens = {r["doc_id"]: words(r["text"]) + ["\0end"] for r in docs.collect()}
    learnt = [words(r["text"]) + ["\0end"] for r in docs.where("doc_id <> 6").collect()]
    counts, pairs = {}, {}
    for t in learnt:
        for h, w in zip(["\0end", *t], t):
            counts[w] = counts.get(w, 0) + 1
            pairs[h, w] = pairs.get((h, w), 0) + 1
    n, v = sum(counts.values()), len(counts)
    alone = lambda w: (counts.get(w, 0) + 1) / (n + v + 1)

    def after(h, w):
        if h not in counts:
            return alone(w)
        novel = language_model.NOVEL * counts[h] ** language_model.GROWTH
        b = novel / (counts[h] + novel)
        return (1 - b) * pairs[h, w] / counts[h] + b * alone(w) if (h, w) in pairs else b * alone(w)

    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(alone(w)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(after(h, w)) for h, w in zip(["\0end", *t], t)))


def test_scores_without_rows_or_training(spark, odd_docs, no_docs):
    assert score_texts(no_docs, F.lit(True)).count() == 0
    empty = score_texts(odd_docs.where("doc_id = 1"), F.lit(None).cast("boolean")).first()
    assert empty["n_known"] == 0 and empty["score"] == 0.0
    none = score_texts(odd_docs.where("doc_id is null"), F.lit(True)).first()
    assert none["doc_id"] is None and none["n_tokens"] == none["n_known"] == 4


def test_presence_equals_a_plain_loop(monkeypatch):
    texts = ["Héllo hello", None, "ab", "", "x\0y", "abc " * 40]
    for size in (1 << 19, 16):
        monkeypatch.setattr(chars, "CHUNK_CHARS", size)
        got = np.concatenate([m for _, m in chars.presence(texts, (1, 2, 3), 15)])
        sets = [{t.lower().replace("\0", " ")[k:k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)} for t in (x or "" for x in texts)]
        assert got.sum(1).tolist() == pytest.approx([len(s) for s in sets], abs=1)
        assert not got[1].any() and not got[3].any()


LANGUAGES = {"en": "the cat and the other house with nothing", "de": "der hund und das haus mit nichts dabei", "fr": "le chien et la maison avec rien du tout"}


def invented(seed, n):
    rng = random.Random(seed)
    return [(i, g, " ".join(rng.choices(LANGUAGES[g].split(), k=rng.randrange(4, 30)))) for i, g in ((i, rng.choice(sorted(LANGUAGES))) for i in range(n))]


def test_languages_held_out(spark, odd_docs, no_docs):
    model = language_id.fit(spark.createDataFrame(invented(1, 300), "doc_id long, lang string, text string"))
    test = spark.createDataFrame(invented(2, 200), "doc_id long, truth string, text string")
    rows = language_id.identify(test, model).collect()
    assert np.mean([r["truth"] == r["lang_pred"] for r in rows]) > 0.98
    odd = {r["doc_id"]: r for r in language_id.identify(odd_docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (2, 3, 4, 7)] == ["und"] * 4 and odd[6]["lang_pred"] != "und" and odd[1]["source"] == "s"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.identify(no_docs, model).count() == 0 and language_id.fit(no_docs) is None
    assert language_id.identify(odd_docs, None).where("lang_pred <> 'und'").count() == 0


def test_copies_and_many_languages_leave_none_out(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FIT_PER_LABEL", 10)
    rows = [("fr", f"{k} le chien et la maison") for k in "abc" for _ in range(150)]
    rows += [("en", f"the cat and the house {i}") for i in range(40)] + [("en", "the cat " * 3)] * 200
    rows += [("de", "nichts dabei")]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.labels == ["de", "en", "fr"] and model.landmarks.shape[1] == 1 + 10 + 3
    monkeypatch.setattr(language_id, "LANDMARK_ROWS", 5)
    monkeypatch.setattr(language_id, "FIT_ROWS", 5)
    names = [f"x{i:02}" for i in range(12)]
    many = spark.createDataFrame([(g, f"{g} {g[::-1]}") for g in names for _ in range(2)], "lang string, text string")
    assert language_id.fit(many).labels == names


def test_toxicity_held_out(spark, odd_docs, no_docs):
    rng = random.Random(5)
    plain = "one two three four five six seven eight nine ten".split()

    def made(n):
        rows = [(i, rng.random() < 0.2) for i in range(n)]
        return [(i, " ".join(rng.choices(plain, k=20) + ["Idiot"] * bad + rng.choices(plain, k=5)), int(bad)) for i, bad in rows]

    train = spark.createDataFrame(made(400), "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.labelled_texts(train.drop("toxic"), train.select("doc_id", "toxic")))
    rows = toxicity.score(spark.createDataFrame(made(200), "doc_id long, text string, truth int"), model).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["truth"]) for r in rows]) > 0.97
    assert toxicity.score(odd_docs, model).where("score between 0 and 1").count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.fit(train.where("toxic = 0").select("text", "toxic")) is None
    assert toxicity.score(odd_docs, None).where("score <> 0").count() == 0


def test_copied_toxic_texts_reach_the_fit(spark, monkeypatch):
    """Few toxic texts with many copies each among many different clean ones, with a small fit sample."""
    from sitewise.llm import toxicity
    monkeypatch.setattr(toxicity, "FIT_ROWS", 100)
    hated = ["you vile stupid fool", "shut up you vile idiot", "stupid idiot, shut up"]
    rows = [(i, f"a calm note number {i * 7919 % 3001} on the garden and the river", 0) for i in range(3000)]
    rows += [(4000 + i, hated[i % 3], 1) for i in range(900)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(labelled, model).collect()}
    found = {t: got[i] for i, t, _ in rows}
    assert all(found[t] > 0.5 for t in hated) and all(s < 0.5 for t, s in found.items() if t.startswith("a calm"))


def test_counts_of_presence_are_those_of_plain_sets(spark):
    from sitewise.llm.toxicity import BITS, SIZES, present
    from sitewise.llm.chars import presence
    texts = ["abc abc", None, "", "Äpfel und abc", "x" * 700, "abcd" * 200]
    who, what = present(texts, np.arange(1 << BITS))
    pairs = {(part.start + i, j) for part, m in presence(texts, SIZES, BITS) for i, j in zip(*np.nonzero(m))}
    assert pairs == set(zip(who.tolist(), what.tolist()))


def test_language_fit_unpacks_few_texts_at_once(spark, monkeypatch):
    rows = spark.createDataFrame(invented(1, 60), "doc_id long, lang string, text string")
    seen, unpack = [], np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda bits, **options: seen.append(len(bits)) or unpack(bits, **options))
    whole = language_id.fit(rows)
    monkeypatch.setattr(language_id, "LANDMARKS_PER_LABEL", 5)
    monkeypatch.setattr(language_id, "FIT_SLICE", 7)
    seen.clear()
    few = language_id.fit(rows)
    assert max(seen[1:]) <= 7 and sum(seen[1:]) > 21
    assert whole.labels == few.labels and np.isfinite(few.weights).all()


def test_scoring_languages_takes_little_memory_beside_its_model():
    import tracemalloc
    rng = np.random.default_rng(5)
    landmarks = (rng.random((1 << language_id.BITS, 8)) < 0.1).astype(np.float32)
    model = language_id.Kernel(["a", "b"], landmarks, np.full(8, 100.0), rng.random((8, 2)), rng.random(2))
    texts = [f"text number {i} of a batch" for i in range(500)]
    whole = model.scores(texts)
    tracemalloc.start()
    model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20, peak  # 40 MB with 256 texts a matrix
    assert np.allclose(whole, np.vstack([model.scores([t]) for t in texts]))
