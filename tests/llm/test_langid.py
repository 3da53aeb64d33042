import math
import random
import zlib

import numpy as np
import pytest
from tests.llm.helpers import none, odd, rows

from xylem.llm import langid


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y, weight = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1]), rng.random((6, 4))
    _, grads = net.gradients(x, y, weight)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = []
        for e in (1e-5, -1e-5):
            net.p[k][at] += e
            loss.append(net.gradients(x, y, weight)[0])
            net.p[k][at] -= e
        assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-6


def test_prediction_equals_training_pass():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], 4)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (1, 5, 128, 129, 400)]
    for text, got in zip(texts, net.predict(texts), strict=True):
        total = np.zeros(2)
        for a in range(0, len(text), langid.WINDOW):
            x = np.frombuffer(text[a : a + langid.WINDOW], np.uint8).astype(int)[:, None]
            after = [np.stack([s[5] for s in net._states(x, d)]) for d in (0, 1)]
            logits = np.concatenate([after[0], after[1][::-1]], axis=2) @ net.p["v"] + net.p["c"]
            e = np.exp(logits - logits.max(axis=2, keepdims=True))
            total += (e / e.sum(axis=2, keepdims=True)).sum(axis=(0, 1))
        assert np.allclose(got, total / len(text), atol=1e-4)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    sounds = {"aa": ["ka", "lo", "mi", "pu"], "bb": ["str", "och", "ung", "ein"], "cc": ["é", "aux", "oi", "ré"]}
    made = [(i, " ".join("".join(rng.choices(sounds[g], k=3)) for _ in range(40)), g) for i in range(300) for g in [rng.choice(list(sounds))]]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    truth = {i: g for i, _, g in made}
    got = langid.predictions(docs).collect()
    test = [r for r in got if r.held_out]
    assert len(got) == 300 and {r.doc_id for r in test} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(truth[r.doc_id] == r.lang_pred for r in test) >= 0.95 * len(test)
    assert langid.keep_known(docs).count() >= 290


def test_sample_windows(spark, monkeypatch):
    texts = ["1 " * 500 + "letters", "x", "αβγ " * 400, "abc " * 1000]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string")
    got = langid.sample(docs)
    assert 4 <= len(got) <= 16
    assert all(0 < len(w) <= langid.WINDOW and any(c.isalpha() for c in w.decode(errors="ignore")) for _, w in got)
    assert {lang for lang, _ in got} == {"aa"} and any(w.startswith(b"letters") for _, w in got)
    many = docs.select("doc_id", "text", "doc_id").toDF("doc_id", "text", "lang")
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.sample(many)


def test_network_forward_equals_plain_loops():
    """A document's probabilities by plain Python loops over bytes, units and gates."""
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b", "c"], 2)
    text = rng.integers(32, 127, 150).astype(np.uint8).tobytes()
    sig = lambda a: 1 / (1 + math.exp(-a))

    def states(window, d):
        w, u, h, out = net.p[f"w{d}"], net.p[f"u{d}"], [0.0, 0.0], []
        for byte in window if d == 0 else reversed(window):
            dot = lambda g, j: sum(h[i] * float(u[g][i][j]) for i in range(2))  # noqa: B023, E731
            z = [sig(float(w[0][byte][j]) + dot(0, j)) for j in range(2)]
            r = [sig(float(w[1][byte][j]) + dot(1, j)) for j in range(2)]
            n = [math.tanh(float(w[2][byte][j]) + r[j] * dot(2, j)) for j in range(2)]
            h = [n[j] + z[j] * (h[j] - n[j]) for j in range(2)]
            out.append(h)
        return out if d == 0 else out[::-1]

    total = [0.0] * 3
    for a in range(0, len(text), langid.WINDOW):
        window = text[a : a + langid.WINDOW]
        for left, right in zip(states(window, 0), states(window, 1), strict=True):
            e = [math.exp(sum(x * float(net.p["v"][i][k]) for i, x in enumerate(left + right)) + float(net.p["c"][k])) for k in range(3)]
            total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
    assert np.allclose(net.predict([text])[0], np.array(total) / len(text), atol=1e-4)


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predictions(odd(spark)).collect()), key=repr)
    assert len(got) == len(rows())
    silent = {r[0] for r in rows() if not any(c.isalpha() for c in r[1] or "")} - {None}
    assert {i for i, lang, _ in got if lang == "und"} - {None} == silent
    assert all(0 <= s <= 1 and lang in ("en", "es", "de", "und") for _, lang, s in got)
    kept = langid.keep_known(odd(spark), 0.0)
    assert kept.columns == odd(spark).columns and kept.count() == len([r for r in got if r[1] != "und"])


def test_empty_and_unlabelled(spark):
    assert langid.predictions(none(spark)).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predictions(docs).select("lang_pred", "score").collect()] == [("und", 0.0)]
