import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.helpers import LOWER, none, odd, words

from xylem.llm import ngram


@pytest.mark.parametrize("n,most", [(1, 0), (5, 100), (1000, 50), (5000, 10**9), (3000, 2**62)])
def test_elias_fano(n, most):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, most + 1, n))
    arrays = {f"x.{k}": v for k, v in ngram.EliasFano.encode(values, most).items()}
    seq = ngram.EliasFano.opened(arrays, "x")
    assert (seq.get(np.arange(n)) == values).all()
    asked = np.concatenate([values[::2], rng.integers(0, most + 1, 100)])
    at = np.searchsorted(values, asked)
    expected = np.where((at < n) & (values[np.minimum(at, n - 1)] == asked), at, -1)
    assert (seq.find(np.zeros(len(asked), np.int64), np.full(len(asked), n), asked) == expected).all()


def test_blocks():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**50, 1000))
    counts = rng.integers(1, 1000, len(keys))
    a, b = ngram.unpack_keys(ngram.pack_keys(keys, counts))
    assert (a == keys).all() and (b == counts).all()
    a, b = ngram.merged([ngram.pack_keys(keys, counts), ngram.pack_keys(keys[::2], counts[::2])])
    assert (a == keys).all() and b.sum() == counts.sum() + counts[::2].sum()


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def brute(rows):
    """Scores of all (id, text) by dictionaries."""
    tokens = [(i, words((t or "").translate(LOWER)) + [" "]) for i, t in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, w in tokens:
        if not held(i):
            s = [" ", *w]
            c1.update(w)
            c2.update(zip(s, s[1:], strict=False))
            c3.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    d2, d3 = (ngram.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (c2, c3))
    s2, s3 = defaultdict(float), defaultdict(float)
    for (a, _), c in c2.items():
        s2[a] += c - d2[min(c, 3)]
    for (a, b, _), c in c3.items():
        s3[a, b] += c - d3[min(c, 3)]
    rest = lambda c, d: c - d[min(c, 3)]

    def p2(a, b):
        lower = (c1[b] + 1) / (n + v + 1)
        return rest(c2[a, b], d2) / c1[a] + max(1 - s2[a] / c1[a], 1e-9) * lower if c1[a] else lower

    def p3(a, b, c):
        if not c2[a, b]:
            return p2(b, c)
        return rest(c3[a, b, c], d3) / c2[a, b] + max(1 - s3[a, b] / c2[a, b], 1e-9) * p2(b, c)

    out = []
    for i, w in tokens:
        s = [" ", *w]
        score = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*s[k - 2 : k + 1])) for k in range(2, len(s)))
        out.append((i, held(i), len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def compare(got, expected):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
        assert abs(a[6] - b[6]) < 5e-4 * b[2] + 1e-6


def test_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(ngram.scores(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_rounds_and_shards(spark, monkeypatch):
    """Blocks merged in several rounds; more shards than shuffle partitions."""
    for name, value in {"SLICE": 20_000, "FAN": 2, "SHARD_BYTES": 100_000}.items():
        monkeypatch.setattr(ngram, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    compare(ngram.scores(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_words_with_shards_of_their_own(spark, monkeypatch):
    """Frequent words, a third of all tokens among them, are cut into pieces; scores stay."""
    monkeypatch.setattr(ngram, "HOT", 40)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6 + i, " hot ".join((t or "").split()[:60])) for i, t in rows]
    folders, train = [], ngram.train
    monkeypatch.setattr(ngram, "train", lambda docs: folders.append(train(docs)) or folders[-1])
    compare(ngram.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))
    trie = ngram.Trie(folders[0])
    assert len(trie.hot) > 3 and trie.pieces.max() > 10
    assert (trie.pieces >= 2).all() and sum(trie._ranks["sizes"]) > 1000


def test_discounts():
    assert ngram.discounts([0, 0, 0, 0])[0] == 0 and (ngram.discounts([9, 0, 0, 0])[1:] > 0).all()
    y = 100 / (100 + 2 * 40)
    assert np.allclose(ngram.discounts([100, 40, 20, 12])[1:], [1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])


def test_better_than_unigrams(spark, sf):
    got = ngram.scores(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("held_out").agg({"base_score": "sum", "score": "sum"}).collect()
    assert all(r["sum(score)"] > r["sum(base_score)"] for r in got)


def test_odd_rows(spark):
    docs = odd(spark)
    compare(ngram.scores(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_empty_and_untrained(spark):
    assert ngram.scores(none(spark)).count() == 0
    alone = next(i for i in range(100) if held(i))
    docs = spark.createDataFrame([(alone, "a b")], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram.scores(docs).collect()] == [(3, 0, 0, 0.0, 0.0)]
