"""Variable-capacity best-fit packing of documents into training sequences.

Texts are encoded to token ids. Several sequence lengths are permitted. Longest pieces are placed first,
each into the open bin with the least room that fits. If none fits, a bin is opened: its size is the one
with the least cost for each token it can be expected to hold, given what is still to be placed. That
plan competes with the plans that always open one fixed size; the plan with the least total cost wins.
At last every bin shrinks to the smallest permitted length that holds its contents.

Bins are packed within groups of about GROUP tokens of one input partition, so nothing is shuffled,
memory is bounded and a retried task packs alike; which texts share a sequence depends on the input
splits. Texts longer than the largest length are split without loss: full pieces and a rest.

Defined cases: a text without tokens (null, empty) has no segment; repeated rows are packed each; ties
are placed in input order; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm import bpe
from xylem.llm.common import slices, whole_text

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 1 << 21
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
PAD = 50256


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: its tokens, and attention that grows with its square (documented default)."""
    return capacity * (1 + capacity / 16384)


class RoomTree:
    """Segment tree over room 0..most: for each room the open bins that have it; finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.filled = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.size
        while at and not self.filled[at]:
            self.filled[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the least room that is at least `need`; the bin leaves the tree."""
        if need >= len(self.bins):
            return None
        filled, at = self.filled, need + self.size
        if not filled[at]:
            while True:
                if at == 1:
                    return None
                if not at & 1 and filled[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at = 2 * at + (not filled[2 * at])
        room = at - self.size
        number = self.bins[room].pop()
        if not self.bins[room]:
            while at and not (filled[2 * at] or filled[2 * at + 1] if at < self.size else False):
                filled[at] = 0
                at >>= 1
        return room, number


def _plan(lengths: list[int], choose: Callable[[int, int], int], most: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the given order. The bin of each piece, its offset there, the tokens of each bin."""
    tree, bins, offsets, opened, used = RoomTree(most), [], [], [], []
    for k, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            opened.append(choose(k, n))
            used.append(0)
            found = opened[-1], len(opened) - 1
        room, number = found
        bins.append(number)
        offsets.append(used[number])
        used[number] += n
        if room > n:
            tree.put(room - n, number)
    return bins, offsets, used


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (lengths from 1 to the largest capacity), and the capacity of each bin."""
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    after = np.concatenate([np.cumsum(down[::-1], dtype=np.int64)[::-1], [0]])  # tokens from a place on
    place = len(down) - np.searchsorted(down[::-1], np.arange(sizes[-1] + 1), side="right")  # first piece of at most so many tokens

    def adaptive(k: int, n: int) -> int:
        """Least cost for each token that the bin can be expected to hold."""
        return min((s for s in sizes if s >= n), key=lambda s: cost(s) / (n + min(s - n, int(after[max(k + 1, int(place[s - n]))]))))

    def fixed(size: int) -> Callable[[int, int], int]:
        return lambda _, n: next(s for s in sizes if s >= max(n, size))

    least = None
    for choose in (adaptive, *map(fixed, sizes)) if len(sizes) > 1 else (fixed(sizes[0]),):
        bins, offsets, used = _plan(down.tolist(), choose, sizes[-1])
        shrunk = np.array(sizes)[np.searchsorted(sizes, used)]
        total = float(sum(cost(int(s)) * n for s, n in zip(*np.unique(shrunk, return_counts=True), strict=True)))
        if least is None or total < least[0]:
            least = total, bins, offsets, shrunk
    _, bins, offsets, shrunk = least
    out_bins, out_offsets = np.empty(len(down), np.int64), np.empty(len(down), np.int64)
    out_bins[order], out_offsets[order] = bins, offsets
    return out_bins, out_offsets, shrunk


def pieces_of(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of the pieces of texts of so many tokens; a text without tokens has none."""
    count = -(-tokens // most)
    text = np.repeat(np.arange(len(tokens)), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * most


#: Columns of a packed sequence, but for the list of doc_ids, whose type is that of the input.
COLUMNS = "seq_id long, capacity int, n_tokens long, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{doc}>, doc_starts array<long>"
NAMES = ["seq_id", "capacity", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "doc_starts"]


def sequences(doc: pa.Array, count: np.ndarray, ids: np.ndarray, capacities: tuple[int, ...], pad: int, kind: str, base: int) -> pa.RecordBatch:
    """Pack the ids of texts (`count` ids each, one after the other) and lay the sequences out."""
    most = max(capacities)
    text, start = pieces_of(count, most)
    n = np.minimum(count[text] - start, most)
    bins, offsets, sizes = pack(n, capacities) if len(n) else (np.empty(0, np.int64),) * 3
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.full(int(ends[-1]), pad, kind)
    # places of all ids, in the shortest integers that hold them
    short = np.int32 if max(len(flat), len(ids)) < 1 << 31 else np.int64
    spread = lambda x: np.repeat(x.astype(short), n)
    inside = np.arange(int(n.sum()), dtype=short)
    inside -= spread(np.cumsum(n) - n)
    source = spread((np.cumsum(count) - count)[text] + start)
    source += inside
    inside += spread(ends[bins] + offsets)
    flat[inside] = ids[source]
    del inside, source
    order = np.lexsort((offsets, bins))
    bins, offsets, text, start, n = (x[order] for x in (bins, offsets, text, start, n))
    edges = np.searchsorted(bins, np.arange(len(sizes) + 1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
    ends_in = np.insert(offsets + n, edges[:-1], 0)
    places = (ends * flat.itemsize).astype(np.int32)
    columns = [
        pa.array(base + np.arange(len(sizes)), pa.int64()),
        pa.array(sizes, pa.int32()),
        pa.array(np.add.reduceat(n, edges[:-1]) if len(sizes) else n, pa.int64()),
        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(flat)]),
        pa.ListArray.from_arrays(pa.array(edges + np.arange(len(edges)), pa.int32()), pa.array(ends_in, pa.int32())),
        lists(pa.array(offsets, pa.int32())),
        lists(doc.take(pa.array(text))),
        lists(pa.array(start, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, ranks: str = bpe.RANKS, pad: int = PAD, group: int = GROUP) -> DataFrame:
    """One row for each sequence: seq_id, capacity, n_tokens, ids, cu_seqlens, resets, doc_ids, doc_starts.

    ids: `capacity` little-endian uint16 (uint32 if an id needs it), filled up with `pad`; cu_seqlens: 0
    and the end of each segment; resets: the places where positions start at 0; doc_starts: a segment's
    place in its document.
    """
    held = docs.select("doc_id", whole_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = bpe.encoder(shared.value)
        kind = "<u2" if max(encoding.max_token_value, pad) < 1 << 16 else "<u4"
        base, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        whole = lambda: sequences(pa.concat_arrays([w[0] for w in waiting]), *(np.concatenate([w[k] for w in waiting]) for k in (1, 2)), capacities, pad, kind, base)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                count, ids = bpe.encoded(encoding, part.column(1))
                waiting.append((part.column(0), count, ids.astype(kind)))
                size += len(ids)
                if size >= group:
                    out = whole()
                    base, waiting, size = base + out.num_rows, [], 0
                    yield out
        if waiting:
            yield whole()

    return held.mapInArrow(run, COLUMNS.format(doc=dict(held.dtypes)["doc_id"]))
