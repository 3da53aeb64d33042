import corpus_pipeline
from tests.llm.helpers import none, odd, recorded, words
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_packing import together
from tests.llm.test_quality import brute as measures
from tests.llm.test_simhash import components, fingerprint

from xylem.llm import bpe, langid, simhash
from xylem.llm.common import materialise


def quality_keeps(text):
    n, chars, symbols, dup, repeated = measures(text)
    lines = len([x for x in (text or "").split("\n") if words(x)])
    return not (n < 20 or 100 * repeated > 30 * n or symbols > 0.25 * n or (lines >= 4 and 100 * dup > 50 * lines) or chars < 2 * n or chars > 20 * n)


def test_stages_equal_brute_force(spark, sf):
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        columns = columns or docs.columns
        out = materialise(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert out.columns == columns
            after = {r.doc_id for r in out.collect()}
            assert out.count() == len(after)
        if name == "quality_rules":
            assert after == {i for i, t in before if quality_keeps(t)}
        elif name == "language_id":
            known = langid.with_language(docs, langid.train(docs)).where("__xylem_lang <> 'und' AND __xylem_score >= 0.4").select("doc_id").collect()
            assert after == {r.doc_id for r in known} and len(after) > 0.95 * len(before)
        elif name == "near_duplicates":
            assert after == set(components([(i, fingerprint(t)) for i, t in before]))
        elif name == "decontamination":
            assert after == {i for i, _ in before} - {d for d, _ in leaks(before, items)}
        else:
            encoding = bpe.encoder(bpe.read_ranks())
            assert together(out.collect()) == {i: encoding.encode_ordinary(t) for i, t in before}
        docs = out


def test_near_duplicates_broadcast_nothing(spark, sf, monkeypatch):
    """What the third stage joins grows with the input; none of it may pass through the driver."""
    plans = recorded(monkeypatch, simhash)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < corpus_pipeline.near_duplicates(spark, docs, sf).count() < docs.count()
    assert {"links", "stars"} <= {k for k, _ in plans} and not [k for k, plan in plans if "Broadcast" in plan]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows(spark, sf):
    """Each stage on what its predecessor kept of the odd rows, against brute force; columns stay."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs, encoding = odd(spark), bpe.encoder(bpe.read_ranks())
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, sf), name)
        after = docs.collect()
        ids = sorted((r.doc_id for r in after), key=repr) if name != "best_fit_packing" else None
        if ids is not None:
            assert docs.columns == odd(spark).columns and all(r in before for r in after)
        if name == "quality_rules":
            assert ids == sorted((r.doc_id for r in before if quality_keeps(r.text)), key=repr) and len(ids) > 4
        elif name == "language_id":
            assert all(any(c.isalpha() for c in r.text) for r in after)
        elif name == "near_duplicates":
            # of equal fingerprints the smallest doc_id, nulls last; one row of each group
            groups = components([(k, fingerprint(r.text)) for k, r in enumerate(before)])
            members = {}
            for k, _ in enumerate(before):
                members.setdefault(groups[k], []).append(before[k].doc_id)
            assert ids == sorted((min((i for i in m if i is not None), default=None) for m in members.values()), key=repr)
        elif name == "decontamination":
            assert ids == sorted((r.doc_id for k, r in enumerate(before) if not leaks([(k, r.text)], items)), key=repr)
        else:
            assert together(after) == {r.doc_id: encoding.encode_ordinary(r.text) for r in before}


def test_empty(spark, sf):
    docs = none(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.count() == 0
