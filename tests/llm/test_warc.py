import gzip
import hashlib

import duckdb
import pytest
from tests.llm.helpers import by_key

from xylem.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long, n long, refers_to string"
BIG = "<p>" + "x" * 200


def pages(spark):
    rows = [(5, "http://a/x", BIG), (3, "http://b/ü\r\nX: y", BIG), (3, "http://b/", BIG), (9, None, BIG), (None, "http://c/", BIG), (1, "http://d/", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, None, "y" * 300), (None, None, "y" * 300), (10, "u", "z\r\n\r\nWARC/1.1\r\n" * 5000), (11, "u", "long " * 400_000)]
    return spark.createDataFrame([(*r, "d", 1, 2, "r") for r in rows], SCHEMA)


def expected(rows):
    sums = {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            sums.setdefault(data, []).append(i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = min((x for x in sums.get(data, []) if x is not None), default=None)
        revisit = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [0, 10**6])
def test_odd_pages(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    got = warc.archived(pages(spark))
    assert by_key(got, *got.columns) == expected([tuple(r) for r in pages(spark).collect()])


def test_empty_table(spark):
    assert warc.archived(pages(spark).limit(0)).count() == 0


def test_normaliser(tmp_path):
    records = [warc.record(f"0:{k}", k, "http://x/", b"p" * k, "d", None) for k in (0, 1, 5000)]
    source, target = str(tmp_path / "a.stream.warc.gz"), str(tmp_path / "a.warc.gz")
    with gzip.open(source, "wb") as f:
        f.write(b"".join(records))
    assert warc.normalise(source, target) == 3
    with gzip.open(target) as f:
        assert f.read() == b"".join(records)
    assert [p for _, p in warc.read_records(target)] == [b"", b"p", b"p" * 5000]
    with open(target, "rb") as f, open(f"{target}.idx") as index:
        data = f.read()
        for line, whole in zip(index, records, strict=True):
            offset, length, _ = line.split("\t")
            assert gzip.decompress(data[int(offset) : int(offset) + int(length)]) == whole
    with gzip.open(source, "wb") as f:
        f.write(b"".join(records)[:-10])
    with pytest.raises(ValueError, match="ends within"):
        warc.normalise(source, target)


def test_damaged_archives_are_told(spark, tmp_path):
    good, bad = (warc.record("0:0", 1, "http://x/", b"payload", d, None) for d in (hashlib.sha256(b"payload").hexdigest(), "0" * 64))
    for name, whole in (("good", good), ("bad", bad)):
        with gzip.open(tmp_path / f"{name}.stream", "wb") as f:
            f.write(whole)
        warc.normalise(str(tmp_path / f"{name}.stream"), str(tmp_path / name))
    archives = lambda name: spark.createDataFrame([(str(tmp_path / name), 1)], "path string, records long")
    assert warc.read_archives(archives("good")).first().payload_digest == hashlib.sha256(b"payload").hexdigest()
    with pytest.raises(Exception, match="isn't what its header says"):
        warc.read_archives(archives("bad")).collect()
    # a second attempt writes the same archive and leaves no part behind
    warc.normalise(str(tmp_path / "good.stream"), str(tmp_path / "good"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad", "bad.idx", "bad.stream", "good", "good.idx", "good.stream"]


def test_sql_counterpart(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = warc.archived(spark.read.parquet(f"{sf}/pages.parquet"))
    assert by_key(got, *got.columns) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({warc.ORACLE})").fetchall(), key=repr)
