import random

import numpy as np
from tests.llm.helpers import none, odd, rows

from xylem.llm import bpe, packing


def check(bins, offsets, sizes, lengths, permitted):
    """No overlap, nothing beyond the end, every bin as small as its contents allow."""
    spans = {}
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        spans.setdefault(int(b), []).append((int(o), int(n)))
    assert set(spans) == set(range(len(sizes)))
    for b, own in spans.items():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert sizes[b] == min(s for s in permitted if s >= end)


def test_tree_finds_least_room():
    rng, tree, model = random.Random(1), packing.RoomTree(100), []
    for k in range(3000):
        if rng.random() < 0.55:
            room = rng.randrange(101)
            tree.put(room, k)
            model.append(room)
        else:
            need = rng.randrange(101)
            best = min((r for r in model if r >= need), default=None)
            found = tree.take(need)
            assert (found[0] if found else None) == best
            if found:
                model.remove(best)


def test_pack_is_valid_and_no_worse_than_one_size():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.geometric(0.004, 2000), 4096)
    bins, offsets, sizes = packing.pack(lengths)
    check(bins, offsets, sizes, lengths, packing.CAPACITIES)
    cost = sum(map(packing.sequence_cost, sizes))
    for one in packing.CAPACITIES:
        if one >= lengths.max():
            assert cost <= sum(map(packing.sequence_cost, packing.pack(lengths, (one,))[2])) + 1e-6
    for n in ([1], [4096], [512] * 7, [1] * 513):
        n = np.array(n)
        check(*packing.pack(n), n, packing.CAPACITIES)


def plainly(lengths, permitted, size):
    """Best fit by going through all open bins, of equal room the last used; None: the size with the least cost for what it can hold."""
    down, bins = sorted(lengths, reverse=True), []
    for k, n in enumerate(down):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
            best[1:] = best[1] + n, k
            continue
        able = [s for s in permitted if s >= max(n, size or 0)]
        holds = lambda s: n + min(s - n, sum(x for x in down[k + 1 :] if x <= s - n))  # noqa: B023, E731
        bins.append([min(able, key=lambda s: packing.sequence_cost(s) / holds(s)) if size is None else able[0], n, k])
    return [min(s for s in permitted if s >= used) for _, used, _ in bins], sorted(used for _, used, _ in bins)


def test_pack_equals_brute_force():
    rng = np.random.default_rng(9)
    for n in (1, 2, 10, 120, 300):
        for permitted in ((512, 1024, 2048, 4096), (100, 4096), (4096,)):
            lengths = np.minimum(rng.geometric(0.002, n), 4096)
            bins, _, sizes = packing.pack(lengths, permitted)
            used = sorted(np.bincount(bins, weights=lengths).astype(int).tolist())
            plans = [plainly(lengths.tolist(), permitted, s) for s in ((None, *permitted) if len(permitted) > 1 else permitted)]
            costs = [sum(map(packing.sequence_cost, p[0])) for p in plans]
            assert abs(sum(map(packing.sequence_cost, sizes)) - min(costs)) < 1e-6
            assert any(used == p[1] for p, c in zip(plans, costs, strict=True) if c - min(costs) < 1e-6)


def together(got, permitted=packing.CAPACITIES):
    """Document -> lists of (start, ids); checks each sequence."""
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.capacity == min(c for c in permitted if c >= r.n_tokens)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == packing.PAD).all()
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            parts.setdefault(doc, []).append((start, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    return {d: [t for _, p in sorted(x) for t in p] for d, x in parts.items()}


def test_odd_rows(spark):
    encoding = bpe.encoder(bpe.read_ranks())
    unique = odd(spark).dropDuplicates(["doc_id", "text"]).where("doc_id IS NOT NULL")
    assert together(packing.packed(unique).collect()) == {r[0]: encoding.encode_ordinary(r[1]) for r in rows() if r[0] is not None and r[1]}
    assert sum(r.n_tokens for r in packing.packed(odd(spark)).collect()) == sum(len(encoding.encode_ordinary(r[1] or "")) for r in rows())
    assert packing.packed(none(spark)).count() == 0


def test_groups(spark, sf):
    docs, encoding = spark.read.parquet(f"{sf}/documents.parquet"), bpe.encoder(bpe.read_ranks())
    expected = {r.doc_id: encoding.encode_ordinary(r.text) for r in docs.collect() if r.text}
    for group in (1, 50_000, 10**9):
        got = packing.packed(docs, group=group).collect()
        assert together(got) == expected and len({r.seq_id for r in got}) == len(got)
