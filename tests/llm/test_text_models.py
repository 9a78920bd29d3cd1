"""Language identification, toxicity and the language model: brute force and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from postwarden.llm import attention_lm, langid, toxicity

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(VOCABULARY)


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    table = np.append(rng.random((len(pieces.tokens), 2)), np.zeros((1, 2)), axis=0)
    number = {t: i for i, t in enumerate(pieces.tokens)}
    for word in (b" the", b" abc", "ü".encode(), b" xyzzy"):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            if all(p in number for p in parts):
                total += np.prod([table[number[p]] for p in parts], axis=0)
        got = pieces.forward(np.frombuffer(word, np.uint8)[None], table)[0]
        assert np.allclose(got, total)


def test_learning_raises_likelihood(pieces):
    counts = {b" lomi": 5.0, b" kater": 3.0, b" minus": 2.0}

    def likelihood(rounds):
        p = langid.learn(pieces, counts, rounds, 1e-6)[:, None]
        return sum(n * math.log(pieces.forward(np.frombuffer(w, np.uint8)[None], p)[0, 0]) for w, n in counts.items())

    assert likelihood(1) < likelihood(3) <= likelihood(6) + 1e-9


def test_language_query(apply, rows):
    out = apply("op1_language_id")
    assert len(out) == len(rows)
    known = {r[0]: r for r in rows if r[0] is not None}
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (200, 201, 202, 203):
            assert (r.lang_pred, r.score) == ("und", 0)
        if r.doc_id is not None and r.doc_id < 80 and r.doc_id != 0:
            assert r.lang_pred == known[r.doc_id][2]


def test_language_operator_on_odd_tables(crowded, none):
    out = langid.identified(crowded, crowded, VOCABULARY, carry=True)
    assert out.select("row.*").columns == crowded.columns and out.count() == crowded.count()
    assert langid.identified(none, crowded, VOCABULARY).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.identified(crowded, none, VOCABULARY).collect()} == {("und", 0.0)}


def toxic_rows(n=400):
    rng = random.Random(2)
    calm = [f"{a}{b}" for a in ("ba", "co", "du", "fe") for b in ("la", "mo", "ni", "ru", "sa")]
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        lines = [" ".join(rng.choices(calm, k=8)) for _ in range(rng.randint(1, 6))]
        if bad:
            lines[rng.randrange(len(lines))] += " zugga" + rng.choice(["", "la", "mo"])
        rows.append((i, ". ".join(lines), int(bad)))
    return rows


def test_toxicity_finds_the_sentence(spark, none):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.scored(df, df.filter("doc_id < 250"), df, locate=0.5).collect()
    label = {r[0]: r[2] for r in rows}
    late = [r for r in out if r.doc_id >= 250]
    assert sum((r.score >= 0.3) == label[r.doc_id] for r in late) >= 0.97 * len(late)
    for r in late:
        if label[r.doc_id] and r.score >= 0.5:
            assert r.offending and all("zugga" in s for s in r.offending)
    assert toxicity.scored(none, df, df).count() == 0


def test_toxicity_noisy_or():
    z = np.array([-2.0, 0.5, -1.0])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(1 - np.exp(toxicity.noisy_or(z, np.array([0, 2]))), [1 - (1 - p[0]) * (1 - p[1]), p[2]])


def test_toxicity_without_labels(docs, none, crowded):
    from pyspark.sql import functions as F

    empty = none.select("doc_id", F.lit(1).alias("toxic"))
    assert {r.score for r in toxicity.scored(docs, docs, empty).collect()} == {0.0}
    out = toxicity.scored(crowded, crowded, empty, carry=True)
    assert out.select("row.*").columns == crowded.columns and out.count() == crowded.count()


def test_toxicity_query(apply, rows):
    out = apply("op10_toxicity")
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_windows_score_each_piece_once():
    rng = np.random.default_rng(3)
    model = attention_lm.AttentionLm(40, rng.random(40) * 9).ready()
    many = [rng.integers(3, 40, n).astype(np.int32) for n in (0, 1, 15, 31, 32, 33, 47, 48, 49, 200)]
    got = model.score(many, rows=3)
    p, w, half = model.p, attention_lm.WINDOW, attention_lm.WINDOW // 2

    def log_probability(context, target):
        x = p["E"][context] + p["P"][: len(context)]
        q, k, v = x[-1] @ p["Q"], x @ p["K"], x @ p["V"]
        a = np.exp(k @ q / np.sqrt(attention_lm.WIDTH))
        h = x[-1] + (a / a.sum()) @ v @ p["O"]
        z = h @ p["U"] + p["b"]
        return z[model.group[target]] - np.log(np.exp(z).sum()) + model.inside[target]

    for ids, score in zip(many, got):
        inputs, targets = [attention_lm.BEGIN, *ids], [*ids, attention_lm.END]
        total = 0.0
        for i, t in enumerate(targets):
            start = 0 if i < w else (i - half) // half * half
            total += log_probability(np.array(inputs[start : i + 1]), t)
        assert score == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_classes_are_a_distribution():
    model = attention_lm.AttentionLm(500, np.arange(500.0))
    assert np.allclose(np.bincount(model.group, np.exp(model.inside)), 1, atol=1e-4)


def test_gradients():
    model = attention_lm.AttentionLm(20, np.ones(20))
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 20, (2, attention_lm.WINDOW + 1))
    mask = np.triu(np.full((attention_lm.WINDOW, attention_lm.WINDOW), -1e9), 1)
    target = model.group[ids[:, 1:]]
    grads = model._gradients(ids[:, :-1], target, mask)

    def loss():
        p = model.p
        x = p["E"][ids[:, :-1]] + p["P"]
        a = attention_lm.softmax(x @ p["Q"] @ (x @ p["K"]).transpose(0, 2, 1) / np.sqrt(attention_lm.WIDTH) + mask)
        z = attention_lm.softmax((x + a @ (x @ p["V"]) @ p["O"]) @ p["U"] + p["b"]).reshape(-1, len(p["b"]))
        return -np.log(z[np.arange(len(z)), target.ravel()]).mean()

    for k in model.p:
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        at = (int(ids[0, 0]), *at[1:]) if k == "E" else at
        old, step = model.p[k][at], 1e-5
        model.p[k][at] = old + step
        up = loss()
        model.p[k][at] = old - step
        assert (up - loss()) / (2 * step) == pytest.approx(grads[k][at], rel=1e-3, abs=1e-6)
        model.p[k][at] = old


def test_lm_query(apply, rows):
    out = apply("op4_attention_scores")
    count, tokens = Counter(), {}
    for key, text, *_ in rows:
        words = [*(text or "").encode().lower().split(), None]
        tokens.setdefault(key, words)
        if key is not None and zlib.crc32(str(key).encode()) % 5 != 1:
            count.update(words)
    n, v = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        words = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r.base_score == pytest.approx(base) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(words), sum(count[w] > 0 for w in words))
        assert -math.inf < r.score < 0  # the model's own: see test_lm_score_is_the_models_own


def test_lm_on_odd_tables(crowded, none):
    from pyspark.sql import functions as F

    path, held = P.path("piece_bpe_32k.model"), F.lit(False)
    assert attention_lm.scored(none, held, path, steps=2).count() == 0
    nothing = attention_lm.scored(crowded, F.lit(True), path, steps=2).collect()
    assert {r.train_tokens for r in nothing} == {0} and len(nothing) == crowded.count()


def test_lm_score_is_the_models_own(docs, monkeypatch):
    from postwarden.llm.common import remainder

    path = P.path("piece_bpe_32k.model")
    own = attention_lm.Pieces(path)
    model = attention_lm.AttentionLm(own.size, np.random.default_rng(4).random(own.size) * 9)
    monkeypatch.setattr(attention_lm, "fitted", lambda *a, **b: model)
    few = docs.filter("doc_id < 9 or doc_id between 200 and 206")
    got = attention_lm.scored(few, remainder("doc_id", 5) == 1, path).collect()
    want = sorted(model.ready().text_scores([attention_lm.words_of(r.text or "") for r in few.collect()], own))
    assert sorted(r.score for r in got) == pytest.approx(want, rel=1e-4)


def test_lm_windows_cover_every_piece_once():
    rng = np.random.default_rng(5)
    for n in (2, 20, 33, 34, 64, 65, 500, 5000):
        stream = np.arange(n)
        seen = np.concatenate([w[:, 1:].ravel() for w in attention_lm.training_windows(np.array_split(stream, 9), rng, chunk=3)])
        assert set(stream[1:]) <= set(seen.tolist()) and len(seen) < n + attention_lm.WINDOW


def test_lm_learns_from_all_documents(spark):
    path = P.path("piece_bpe_32k.model")
    own = attention_lm.Pieces(path)
    # More documents than the former sample of 1,500, and words that only single ones hold.
    texts = [f"the page number {i} of {i * 7919 % 9973}" for i in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = attention_lm.fitted(rows, path, "text", 2)
    counts = np.zeros(own.size)
    for t in texts:
        words = attention_lm.words_of(t)
        own.learn(set(words))
        counts += np.bincount([*own(words), attention_lm.END], minlength=own.size)
    fresh = attention_lm.AttentionLm(own.size, counts)
    assert np.array_equal(got.group, fresh.group) and np.allclose(got.inside, fresh.inside)
    moved = (got.p["E"] != fresh.p["E"]).any(axis=1)
    assert set(np.flatnonzero(moved)) >= set(np.flatnonzero(counts)) - {attention_lm.END}


def test_lm_changes_average_by_weight():
    start = attention_lm.AttentionLm(30, np.ones(30))
    total = 0
    for by, n in ((1.0, 1), (4.0, 2)):
        one = attention_lm.AttentionLm(30, np.ones(30))
        for v in one.p.values():
            v += np.float32(by)
        total = total + one.change(start.p, np.where(np.arange(30) == 3, 0, n))
    moved = attention_lm.AttentionLm(30, np.ones(30))
    moved.move(total)
    for k, v in moved.p.items():
        want = np.full(v.shape, 3.0)
        if k == "E":
            want[3] = 0
        assert np.allclose(v - start.p[k], want, atol=1e-4)


def test_lm_texts_are_cut_once(docs, monkeypatch):
    from postwarden.llm.common import remainder

    calls, real = [], attention_lm.numbered
    monkeypatch.setattr(attention_lm, "numbered", lambda *a: calls.append(real(*a)) or calls[-1])
    few = docs.filter("doc_id < 30 or doc_id between 200 and 209")
    path = P.path("piece_bpe_32k.model")
    assert attention_lm.scored(few, remainder("doc_id", 5) == 1, path, steps=2).count() == few.count()
    assert len(calls) == 1  # counting, training and scoring read the same numbers
    own, rows = attention_lm.Pieces(path), calls[0].filter("key is null and part is null").collect()
    texts = {r.doc_id: r.text for r in few.collect() if r.doc_id != 0}
    assert len(rows) == few.count()
    for r in rows:
        if r.id in texts:
            words = attention_lm.words_of(texts[r.id] or "")
            own.learn(words)
            assert np.frombuffer(r.pieces, np.uint16).tolist() == [attention_lm.BEGIN, *own(words), attention_lm.END]
            assert len(attention_lm.from_planes(r.words)) == len(words)
            assert (r.slice is not None) == (zlib.crc32(str(r.id).encode()) % 5 != 1 and texts[r.id] is not None)


def test_lm_cut_gives_words_of():
    import pyarrow as pa

    odd = ["", " ", None, "  a b\x0bc\x0c d\x1c\x85\xa0 e\n", "A\tÀB b", "x\x00y  \r\n", "日本 語 a"]
    size, words, index = attention_lm.cut(pa.array(odd, pa.string()))
    ends = np.append(0, np.cumsum(size))
    got = [[words[i] for i in index[x:y]] for x, y in zip(ends[:-1], ends[1:])]
    assert got == [attention_lm.words_of(t or "") for t in odd]


def test_lm_weights_of_any_size():
    seen = np.tri(3, dtype=np.float32)
    for by in (1, 100, 1000, -1000):
        logits = (np.arange(9).reshape(1, 3, 3) * by).astype(np.float32)
        z, total = attention_lm.weights(lambda logits=logits: logits.copy(), seen)
        kept = np.where(seen > 0, logits.astype(float), -np.inf)
        exact = np.exp2(kept - kept.max(axis=-1, keepdims=True))
        assert np.allclose(z / total, exact / exact.sum(-1, keepdims=True), atol=1e-6)
