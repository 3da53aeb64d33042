import random

import pytest
import xxhash
from tests.llm.helpers import LOWER, PROSE, by_key, executed, none, odd, recorded, rows, words

from xylem.llm import simhash


@pytest.fixture
def plans(monkeypatch):
    return recorded(monkeypatch, simhash)


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs):
    """(id or None, fingerprint) -> the smallest id each row's fingerprint reaches."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    lowest = {}
    for i, f in pairs:
        if i is not None:
            lowest[find(f)] = min(i, lowest.get(find(f), i))
    return [lowest.get(find(f)) for _, f in pairs]


def test_odd_rows(spark):
    pairs = [(r[0], fingerprint(r[1])) for r in rows()]
    expected = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, components(pairs), strict=True)), key=repr)
    assert by_key(simhash.classes(odd(spark)), "doc_id", "fingerprint", "component_id") == expected


def test_near_copies_and_hot_variants(spark):
    rng = random.Random(3)
    base = PROSE.split() * 8
    texts = [(i, " ".join(w if rng.random() > 0.01 else f"z{rng.randrange(9)}" for w in base)) for i in range(150)]
    pairs = [(i, fingerprint(t)) for i, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows_ = simhash.materialise(simhash.with_fingerprint(docs, keep=["doc_id"]), "t")
    for hot in (1, 10_000):
        got = rows_.join(simhash.with_component(rows_, hot_variant=hot), simhash.FP)
        assert [c for _, c in by_key(got, "doc_id", "component")] == [c for _, c in sorted(zip([i for i, _ in pairs], components(pairs), strict=True), key=repr)]


def test_links_are_all_found_once(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        prints |= {f, *(f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4))}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for hot in (0, 100):
        assert sorted(map(tuple, simhash.links(nodes, hot).collect())) == expected


def test_what_grows_is_not_broadcast(spark, plans):
    """The variants are 64 rows for each fingerprint, whatever Spark takes their size for; in edges and slots, too, the driver holds nothing."""
    rng = random.Random(7)
    prints = [rng.getrandbits(63) for _ in range(100)]
    nodes = simhash.materialise(spark.createDataFrame([(f,) for f in prints], "fp long"), "nodes")
    for hot in (0, 1000):
        plan = executed(simhash.links(nodes, hot))
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "Inner" in x]
    plans.clear()
    docs = spark.createDataFrame([(i, f"{PROSE} {i % 7} {PROSE}") for i in range(50)], "doc_id long, text string")
    assert simhash.classes(docs).count() == 50
    assert {"links", "stars"} <= {k for k, _ in plans} and not [k for k, plan in plans if "Broadcast" in plan]


def test_components_reach_rows_without_the_driver(spark):
    """The plan as it ran: Spark would broadcast what it then measures as small, up to its threshold."""
    got = simhash.classes(spark.createDataFrame([(i, f"{PROSE} {i % 7} {PROSE}") for i in range(50)], "doc_id long, text string"))
    assert len(got.collect()) == 50
    plan = executed(got)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_of_each_component_stays(spark):
    docs = odd(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    pairs = [(r[0], fingerprint(r[1])) for r in rows()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(pairs)))


def test_empty_table(spark):
    assert simhash.classes(none(spark)).count() == 0
    assert simhash.keep_one(none(spark)).count() == 0
