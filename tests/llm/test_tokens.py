import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import none, odd, rows

from xylem.llm import bpe, packing, tokens


@pytest.fixture(scope="module")
def encoding():
    return bpe.encoder(bpe.read_ranks())


def together(got):
    """Document -> ids, from the matrices; checks the rows on the way."""
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == tokens.LENGTH and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == packing.PAD).all()
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            parts.setdefault(doc, []).append((start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    return {d: [t for _, p in sorted(x) for t in p] for d, x in parts.items()}


def test_encoding_equals_tokenizer(encoding):
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a \n b", "it's John's 12 x", "x\u00a0y z", "x \u00a0y", "日本 語", "a\tb c", "\x85 a", "a\x0bb c", "don 't", "end. Next\nline", None, "\u3000 x", "a\u2028 b", "a b\u200b c"]
    count, ids = bpe.encoded(encoding, pa.array(texts, pa.string()))
    expected = [encoding.encode_ordinary(t or "") for t in texts]
    assert count.tolist() == list(map(len, expected)) and ids.tolist() == [t for x in expected for t in x]


def test_round_trip(spark, sf, encoding):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = tokens.packed(docs).collect()
    assert together(got) == {r.doc_id: encoding.encode_ordinary(r.text) for r in docs.collect()}
    assert len({r.seq_id for r in got}) == len(got)
    assert sum(r.n_tokens for r in got) > 0.95 * tokens.LENGTH * len(got)


def test_odd_and_empty(spark, encoding):
    unique = odd(spark).dropDuplicates(["doc_id", "text"]).where("doc_id IS NOT NULL")
    texts = {r[0]: r[1] for r in rows() if r[0] is not None and r[1]}
    assert together(tokens.packed(unique, group=5000).collect()) == {i: encoding.encode_ordinary(t) for i, t in texts.items()}
    assert sum(r.n_tokens for r in tokens.packed(odd(spark)).collect()) == sum(len(encoding.encode_ordinary(r[1] or "")) for r in rows())
    assert tokens.packed(none(spark)).count() == 0


def test_rows_are_those_of_plain_best_fit(spark, sf, encoding):
    """Best-fit decreasing by going through all open rows gives the same rows' loads."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    lengths = []
    for r in docs.collect():
        n = len(encoding.encode_ordinary(r.text))
        lengths += [tokens.LENGTH] * (n // tokens.LENGTH) + ([n % tokens.LENGTH] if n % tokens.LENGTH else [])
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(tokens.LENGTH - n)
    got = tokens.packed(docs, group=10**9).collect()
    assert sorted(r.n_tokens for r in got) == sorted(tokens.LENGTH - x for x in room)


def test_raw_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows_ = tokens.packed(docs)
    for _ in range(2):  # a second attempt writes the same files
        done = tokens.write_matrices(rows_, str(tmp_path)).collect()
    assert len(list(tmp_path.iterdir())) == len(tokens.SUFFIXES) * len(done)
    for r in done:
        n = np.fromfile(f"{r.path}.ids.bin", "<u2").reshape(-1, tokens.LENGTH)
        ends = np.fromfile(f"{r.path}.rows.bin", "<i8").reshape(-1, 2)
        cu, resets = np.fromfile(f"{r.path}.cu.bin", "<i4"), np.fromfile(f"{r.path}.resets.bin", "<i4")
        assert len(n) == len(ends) == r.rows and len(cu) == ends[-1, 0] and len(resets) == ends[-1, 1]
    order = lambda df: sorted(df.collect(), key=lambda r: r.seq_id)
    assert order(tokens.matrices(docs)) == order(rows_)
    assert tokens.matrices(none(spark)).count() == 0 and together(tokens.matrices(odd(spark).where("doc_id = 12")).collect())
