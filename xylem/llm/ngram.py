"""N-gram language model: a trie of order 3 in Elias-Fano levels that are memory-mapped and shared.

Tokens: words lower-cased (A-Z), then one end. Words are known by the upper 63 bits of their XXH64.

Levels, each in shards (one file a shard, in the mounted shared folder):
1. the sorted word hashes; a word's id is its place. Payload: exact count, quantised back-off weight.
2. for each word, monotone pointers to its successors and their ids. Payload: quantised smoothed
   log-probability of the bigram and its back-off weight as a context.
3. for each bigram (a, b), pointers and, context-relative, the places of c among the successors of b.
   Payload: quantised smoothed log-probability.
Within a level the ids of all nodes form one rising sequence: each node's ids are shifted by the last
value of the node before. A lookup reads two pointers and does one successor search in that range.

Smoothing: add-one unigrams; above, interpolation with the lower order by absolute discounts for counts
of one, two and more, reckoned for each order from how many n-grams were seen one to four times. Every
n-gram is stored; the discounted mass goes to the back-off weight, which makes the distribution sum to
one before quantisation (steps of 1 / QUANTA in log10).

Distribution: shards follow ranges of the word hash; there are spark.sql.shuffle.partitions of them, or
one for SHARD_BYTES of training text if that is more. One pass over the training texts counts each
order. A task counts within SLICE bytes and sends each shard one block of sorted, delta-coded keys.
Blocks of a shard are merged in rounds of about FAN, so no task takes more than that. A word seen more often than a
shard's even share of tokens (fewer words than shards are) has shards of its own in levels 2 and 3, each with a range
of the successors' ids; the word's discounted mass is summed over them, and a place among its successors counts through them. When the counts of
all shards stand and the discounts are known, a task for each shard builds its level. Files are renamed
into place when whole, so a repeated task writes the same file. The order-3 pass looks bigrams up in level 2, which makes its keys context-relative. Scoring is one map over
all texts; only one row for each shard ever reaches the driver.

Defined cases: a null, empty or blank text is one end token; no training text at all gives N = 0 and
V = 0, and every score equals the base; repeated rows count and are scored each time; a null doc_id
is the text '' for the split; very long texts are cut into no pieces (a slice holds at least one text);
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.common import held_out, mounted_dir, slices, word_lists

QUANTA, SLICE = 4096, 8 << 20
SHARD_BYTES, FAN = 64 << 20, 256
#: A word gets shards of its own if it is seen more often than a shard's even share of tokens over this. Layout only.
HOT = 1
HASH_BITS = 63
#: No word holds a blank, so this is nobody's.
END = xxhash.xxh64_intdigest(b" ", 0) >> 1
#: SELECT8[8 * b + k]: place of the k-th one in byte b.
SELECT8 = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(np.int64).ravel()
#: Masks of every second bit, pair and nibble, and the lowest and highest bit of each byte.
BITS, PAIRS, NIBBLES, LOW, HIGH = (np.uint64(int(x * (16 // len(x)), 16)) for x in ("5", "3", "0F", "01", "80"))


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one in each word; both uint64, k less than the ones of the word."""
    one, two, four, seven, eight, top, byte = (np.uint64(n) for n in (1, 2, 4, 7, 8, 56, 255))
    sums = x - ((x >> one) & BITS)
    sums = (sums & PAIRS) + ((sums >> two) & PAIRS)
    sums = ((sums + (sums >> four)) & NIBBLES) * LOW  # byte b: the ones of bytes 0 to b
    place = (((((((k * LOW) | HIGH) - sums) & HIGH) >> seven) * LOW) >> top) * eight  # 8 for each byte that is passed
    inside = k - (((sums << eight) >> place) & byte)
    return place.astype(np.int64) + SELECT8[(((x >> place) & byte) * eight + inside).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of n values from 0 to `most`; vectors of queries.

    ones and zeros: how many of either stand before each word of the high bits.
    """

    def __init__(self, n: int, low_bits: int, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.l, self.high, self.ones, self.zeros, self.low = n, low_bits, high, ones, zeros, low

    @staticmethod
    def encode(values: np.ndarray, most: int) -> dict[str, np.ndarray]:
        values, n = values.astype(np.int64), len(values)
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        bits = np.zeros(-(-(n + (most >> low_bits) + 2) // 64) * 64, np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            part = (values & ((1 << low_bits) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.add.reduceat(part << off, first)
            over = np.flatnonzero(off.astype(np.int64) + low_bits > 64)
            low[word[over] + 1] += part[over] >> (np.uint64(64) - off[over])
        return {"head": np.array([n, low_bits], np.int64), "high": high, "ones": ones, "zeros": 64 * np.arange(len(ones), dtype=np.int64) - ones, "low": low}

    @staticmethod
    def opened(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = arrays[f"{name}.head"].tolist()
        return EliasFano(n, low_bits, *(arrays[f"{name}.{k}"] for k in ("high", "ones", "zeros", "low")))

    def _select(self, i: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the i-th one (or zero) of the high bits."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, i, side="right") - 1
        x = self.high[word]
        return word * 64 + select_in_word(~x if zero else x, (i - before[word]).astype(np.uint64))

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """Ones in a row from a place of the high bits on, 64 at most."""
        high = self.high
        word, off = at >> 6, (at & 63).astype(np.uint64)
        bits = ~((high[word] >> off) | ((high[np.minimum(word + 1, len(high) - 1)] << (np.uint64(63) - off)) << np.uint64(1)))
        return np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        at = i * self.l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[word] >> off) | ((self.low[word + 1] << (np.uint64(63) - off)) << np.uint64(1))
        return (both & np.uint64((1 << self.l) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i) << self.l) | self._low(i)

    def find(self, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Place in [start, stop) of the value, or -1: successor search for the first that isn't less."""
        h = value >> self.l
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) + 1, 0)  # of the first with these high bits
        a, b = at - h, at - h + self._ones_from(at)
        long = np.flatnonzero(b - a == 64)
        if len(long):
            b[long] = self._select(h[long], True) - h[long]
        a, b = np.clip(a, start, stop), np.clip(b, start, stop)
        end, want = b.copy(), value & ((1 << self.l) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        hit = a < end
        hit[hit] = self._low(a[hit]) == want[hit]
        return np.where(hit, a, -1)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON head and the arrays, each at a multiple of 64 bytes; appears whole or not at all."""
    places, at = {}, 0
    for k, x in arrays.items():
        places[k] = [str(x.dtype), len(x), at]
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(places).encode()
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(b"\0" * (-f.tell() % 64))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * (-x.nbytes % 64))
    os.replace(part, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(8 + size) // 64) * 64
    return {k: raw[base + at : base + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * QUANTA), 0, 65535).astype(np.uint16)


class Level:
    """Nodes with pointers and child ids of one shard of level 2 or 3."""

    def __init__(self, path: str):
        arrays = map_arrays(path)
        self.pointers, self.ids = EliasFano.opened(arrays, "pointers"), EliasFano.opened(arrays, "ids")
        self.prob, self.back = arrays["prob"], arrays["back"]

    @staticmethod
    def write(path: str, nodes: int, node: np.ndarray, child: np.ndarray, prob: np.ndarray, back: np.ndarray) -> None:
        """node, child: sorted pairs. A node's child ids, plus 1, are shifted by the last value before them."""
        pointers = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=nodes))]).astype(np.int64)
        last = np.flatnonzero(np.diff(node, append=-1))  # the last child of each node that has any
        shift = np.concatenate([[0], np.cumsum(child[last] + 1)])[: len(last)]
        values = child + 1 + np.repeat(shift, np.diff(last, prepend=-1))
        parts = {f"pointers.{k}": v for k, v in EliasFano.encode(pointers, len(node)).items()}
        parts |= {f"ids.{k}": v for k, v in EliasFano.encode(values, int(values[-1]) if len(values) else 0).items()}
        write_arrays(path, parts | {"prob": quantise(prob), "back": quantise(back)})

    def find(self, node: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each (node, child) or -1, and the node's first place; a run of one node is looked up once."""
        new = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.empty(0, bool)
        run, nodes = np.cumsum(new) - 1, node[new]
        starts, stops = self.pointers.get(nodes), self.pointers.get(nodes + 1)
        found = np.full(len(node), -1, np.int64)
        if self.ids.n:
            shifts = np.zeros(len(nodes), np.int64)
            later = np.flatnonzero((stops > starts) & (starts > 0))
            shifts[later] = self.ids.get(starts[later] - 1)
            some = np.flatnonzero((stops > starts)[run])
            value = shifts[run[some]] + child[some] + 1
            within = value <= self.last
            some, value = some[within], value[within]
            found[some] = self.ids.find(starts[run[some]], stops[run[some]], value)
        return found, starts[run]

    @property
    def last(self) -> int:
        if not hasattr(self, "_last"):
            self._last = int(self.ids.get(np.array([self.ids.n - 1]))[0])
        return self._last

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """node and child of every place."""
        pointers = self.pointers.get(np.arange(self.pointers.n))
        node = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
        values = self.ids.get(np.arange(self.ids.n)) if self.ids.n else np.empty(0, np.int64)
        start = pointers[node]
        shift = np.where(start > 0, values[start - 1], 0) if len(values) else values
        return node, values - shift - 1


class Trie:
    """The model's folder. Shards are mapped when first needed."""

    def __init__(self, folder: str):
        self.folder, self.cached = folder, {}
        with open(f"{folder}/meta.json") as f:
            meta = json.load(f)
        self.shards, self.total = meta["shards"], meta["tokens"]
        self.base = np.concatenate([[0], np.cumsum(meta["words"])]).astype(np.int64)
        self.size = int(self.base[-1])
        self.hot, self.hot_count, self.pieces = (np.array(meta[k], np.int64) for k in ("hot", "hot_count", "pieces"))
        self.first = self.shards + np.cumsum(self.pieces) - self.pieces  # shard of each hot word's first piece
        self.all_shards = self.shards + int(self.pieces.sum())

    @functools.cached_property
    def _ranks(self) -> dict:
        """Known once level 2 stands."""
        with open(f"{self.folder}/ranks.json") as f:
            return json.load(f)

    @functools.cached_property
    def rank_bits(self) -> int:
        """Bits of a place among the successors of a word."""
        return self._ranks["bits"]

    @functools.cached_property
    def _filled(self) -> np.ndarray:
        """Bigrams in all pieces before each piece."""
        return np.concatenate([[0], np.cumsum(self._ranks["sizes"])]).astype(np.int64)

    def hot_at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ids are hot words, and the numbers of those among the hot words."""
        if not len(self.hot):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
        hit = np.flatnonzero(self.hot[at] == ids)
        return hit, at[hit]

    def word_of_piece(self, s: int) -> int:
        """Number, among the hot words, of the word that this shard has a piece of."""
        return int(np.searchsorted(self.first, s, side="right")) - 1

    def before_piece(self, s: int) -> int:
        """Successors of the shard's word in the pieces before; 0 for the shard of many words."""
        return int(self._filled[s - self.shards] - self._filled[self.first[self.word_of_piece(s)] - self.shards]) if s >= self.shards else 0

    def shard_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shard = self.shard_of_id(a)
        at, word = self.hot_at(a)
        shard[at] = self.first[word] + b[at] * self.pieces[word] // self.size
        return shard

    def node_base(self, shard: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Id of a shard's first node; a piece has one node, its word."""
        return np.where(shard < self.shards, self.base[np.minimum(shard, self.shards - 1)], a)

    def _shard(self, name: str, make):
        if name not in self.cached:
            self.cached[name] = make(f"{self.folder}/{name}")
        return self.cached[name]

    def level1(self, s: int) -> tuple[EliasFano, dict[str, np.ndarray]]:
        def make(path: str):
            arrays = map_arrays(path)
            return EliasFano.opened(arrays, "hash"), arrays

        return self._shard(f"1-{s}", make)

    def level(self, order: int, s: int) -> Level:
        return self._shard(f"{order}-{s}", Level)

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = shard.astype(np.uint16) if self.all_shards < 1 << 16 else shard  # sorted by radix
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.all_shards + 1))
        for s in np.unique(shard):
            yield int(s), order[ends[s] : ends[s + 1]]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, -1 for a word that training never saw."""
        ids = np.full(len(hashes), -1, np.int64)
        for s, at in self.by_shard(shard_of(hashes, self.shards)):
            seq, arrays = self.level1(s)
            if seq.n:
                value = hashes[at] - int(arrays["range"][0])
                within = (value >= 0) & (value <= int(arrays["range"][1]))
                at, value = at[within], value[within]
                place = seq.find(np.zeros(len(at), np.int64), np.full(len(at), seq.n), value)
                ids[at] = np.where(place >= 0, place + self.base[s], -1)
        return ids

    def shard_of_id(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, ids, side="right") - 1

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and back-off weight (log10) of each word; 0 and 0 for id -1."""
        count, back = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        known = np.flatnonzero(ids >= 0)
        for s, at in self.by_shard(self.shard_of_id(ids[known])):
            at = known[at]
            local = ids[at] - self.base[s]
            count[at] = self.level1(s)[1]["count"][local]
            if os.path.exists(f"{self.folder}/2-{s}"):
                back[at] = self._shard(f"b-{s}", lambda path: map_arrays(path)["back"])[local] / -QUANTA
        return count, back

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.size + 1))

    def bigrams(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of known pairs: shard, place there or -1, place among a's successors, log10 probability."""
        shard = self.shard_of_pair(a, b)
        place, rank, prob = np.full(len(a), -1, np.int64), np.full(len(a), -1, np.int64), np.zeros(len(a))
        for s, at in self.by_shard(shard):
            level = self.level(2, s)
            found, start = level.find(a[at] - (self.base[s] if s < self.shards else a[at]), b[at])
            hit = found >= 0
            at, found = at[hit], found[hit]
            place[at], rank[at] = found, found - start[hit] + self.before_piece(s)
            prob[at] = level.prob[found] / -QUANTA
        return shard, place, rank, prob

    def ranked(self, a: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 probability of each word's successor of that rank."""
        shard, within, prob = self.shard_of_id(a), rank.copy(), np.zeros(len(a))
        at, word = self.hot_at(a)
        if len(at):
            overall = self._filled[self.first[word] - self.shards] + rank[at]
            piece = np.searchsorted(self._filled, overall, side="right") - 1
            shard[at], within[at] = self.shards + piece, overall - self._filled[piece]
        for s, own in self.by_shard(shard):
            level = self.level(2, s)
            start = level.pointers.get(a[own] - self.base[s]) if s < self.shards else 0
            prob[own] = level.prob[start + within[own]] / -QUANTA
        return prob


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> 32) * shards >> (HASH_BITS - 32)


_TRIES: dict[str, Trie] = {}


def opened(folder: str) -> Trie:
    """The trie of this worker; one at a time stays mapped."""
    if folder not in _TRIES:
        _TRIES.clear()
        _TRIES[folder] = Trie(folder)
    return _TRIES[folder]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, number of each token among them, tokens of each text): words, then the end."""
    per_text, flat = word_lists(texts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.append((np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64), END)
    ends = np.cumsum(per_text)
    tokens = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(hashes) - 1)
    return hashes, tokens, per_text + 1


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as byte planes of the deltas."""
    out = [len(keys).to_bytes(4, "little")]
    for x in (np.diff(keys, prepend=0), counts):
        planes = max(1, (int(x.max()).bit_length() + 7) // 8)
        out.append(bytes([planes]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())
    return b"".join(out)


def unpack_keys(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int.from_bytes(block[:4], "little"), 4, []
    for _ in range(2):
        planes = block[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :planes] = np.frombuffer(block, np.uint8, n * planes, at + 1).reshape(planes, n).T
        out.append(x.view("<i8").ravel())
        at += 1 + n * planes
    return np.cumsum(out[0]), out[1]


def merged(blocks) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blocks and their summed counts."""
    parts = [unpack_keys(b) for b in blocks]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One block for each shard; keys rise within a shard."""
    order = np.lexsort((keys, shard))
    shard, keys, counts = shard[order], keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
        yield int(shard[a]), pack_keys(keys[a:b], counts[a:b])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def pairs_of(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end before the first of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return before


def _unigram_blocks(texts: pa.Array, shards: int, folder: str | None) -> Iterator[tuple[int, bytes]]:
    hashes, tokens, _ = token_hashes(texts)
    counts = np.bincount(tokens, minlength=len(hashes))
    hashes, at = np.unique(hashes, return_inverse=True)
    yield from _blocks(shard_of(hashes, shards), hashes, np.bincount(at, weights=counts).astype(np.int64))


def _known_tokens(trie: Trie, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    hashes, tokens, lengths = token_hashes(texts)
    ids = trie.words(hashes)
    return ids[tokens], lengths, int(ids[-1])


def _bigram_blocks(texts: pa.Array, shards: int, folder: str) -> Iterator[tuple[int, bytes]]:
    trie = opened(folder)
    ids, lengths, end = _known_tokens(trie, texts)
    keys, counts = _counted(pairs_of(ids, lengths, end) * trie.size + ids)
    a = keys // trie.size
    shard = trie.shard_of_pair(a, keys - a * trie.size)
    yield from _blocks(shard, keys - trie.node_base(shard, a) * trie.size, counts)


def distinct_bigrams(trie: Trie, ids: np.ndarray, lengths: np.ndarray, end: int):
    """What Trie.bigrams finds for each token's pair (before, token), looked up once for each distinct pair."""
    before = pairs_of(ids, lengths, end)
    known = np.flatnonzero((before >= 0) & (ids >= 0))
    keys, at = np.unique(before[known] * trie.size + ids[known], return_inverse=True)
    found = trie.bigrams(keys // trie.size, keys % trie.size)
    out = []
    for x, empty in zip(found, (-1, -1, -1, 0.0), strict=True):
        whole = np.full(len(ids), empty, x.dtype)
        whole[known] = x[at]
        out.append(whole)
    return before, out


def trigram_keys(place: np.ndarray, rank: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose pair and the pair before are stored, and their keys: place of the pair before, rank among successors."""
    first = np.zeros(len(place), bool)
    first[np.cumsum(lengths) - lengths] = True
    at = np.flatnonzero(~first[1:] & (place[1:] >= 0) & (place[:-1] >= 0)) + 1
    return at, place[at - 1] << bits | rank[at]


def _trigram_blocks(texts: pa.Array, shards: int, folder: str) -> Iterator[tuple[int, bytes]]:
    trie = opened(folder)
    ids, lengths, end = _known_tokens(trie, texts)
    _, (shard, place, rank, _) = distinct_bigrams(trie, ids, lengths, end)
    at, keys = trigram_keys(place, rank, lengths, trie.rank_bits)
    of = shard[at - 1]
    for s, own in trie.by_shard(of):
        yield s, pack_keys(*_counted(keys[own]))


def discounts(seen: list[int]) -> np.ndarray:
    """Discount of a count of 1, 2 and more (at 1, 2, 3) from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    one, two = seen[:2]
    y = one / (one + 2 * two) if one else 0.5
    ratio = [seen[k + 1] / seen[k] if seen[k] else 0.5 for k in range(3)]
    return np.array([0.0, *[min(max(k - (k + 1) * y * ratio[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]])


def _build1(folder: str, s: int, blocks) -> tuple[int, ...]:
    hashes, counts = merged(blocks) if len(blocks) else (np.empty(0, np.int64),) * 2
    low, span = (int(hashes[0]), int(hashes[-1] - hashes[0])) if len(hashes) else (0, 0)
    parts = {f"hash.{k}": v for k, v in EliasFano.encode(hashes - low, span).items()}
    write_arrays(f"{folder}/1-{s}", parts | {"count": counts, "range": np.array([low, span], np.int64)})
    return len(hashes), int(counts.sum()), 0, 0, 0, 0


def _counts_kept(order: int):
    def build(folder: str, s: int, blocks) -> tuple[int, ...]:
        keys, counts = merged(blocks) if len(blocks) else (np.empty(0, np.int64),) * 2
        write_arrays(f"{folder}/k{order}-{s}", {"block": np.frombuffer(pack_keys(keys, counts) if len(keys) else b"", np.uint8)})
        return len(keys), int(counts.sum()), *np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()

    return build


def _kept(folder: str, order: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    block = map_arrays(f"{folder}/k{order}-{s}")["block"].tobytes()
    return unpack_keys(block) if block else (np.empty(0, np.int64),) * 2


def _hot_back(trie: Trie, counted: list[tuple[int, ...]], discount: np.ndarray) -> np.ndarray:
    """Back-off weight of each hot word, from what the pass tells of its pieces."""
    if not len(trie.hot):
        return np.empty(0)
    n, total, one, two = np.array([r[1:5] for r in counted[trie.shards :]], np.int64).T
    rest = total - discount[1] * one - discount[2] * two - discount[3] * (n - one - two)
    return np.maximum(1 - np.add.reduceat(rest, trie.first - trie.shards) / trie.hot_count, 1e-9)


def _build2(folder: str, s: int, discount: np.ndarray, hot_back: np.ndarray) -> int:
    """Writes level 2; the most successors of a word."""
    trie = opened(folder)
    keys, counts = _kept(folder, 2, s)
    node, child = keys // max(trie.size, 1), keys % max(trie.size, 1)
    rest = counts - discount[np.minimum(counts, 3)]
    if s < trie.shards:
        own = int(trie.base[s + 1] - trie.base[s])
        context = np.asarray(trie.level1(s)[1]["count"])
        back = np.maximum(1 - np.bincount(node, weights=rest, minlength=own) / np.maximum(context, 1), 1e-9)
        here, word = trie.hot_at(np.arange(own) + trie.base[s])
        back[here] = hot_back[word]
        write_arrays(f"{folder}/b-{s}", {"back": quantise(np.log10(back))})
    else:
        own, word = 1, trie.word_of_piece(s)
        context, back = trie.hot_count[word : word + 1], hot_back[word : word + 1]
    lower = 10 ** trie.unigram(trie.counts(child)[0])
    prob = rest / context[node] + back[node] * lower
    Level.write(f"{folder}/2-{s}", own, node, child, np.log10(prob), np.empty(0))
    return int(np.bincount(node).max()) if len(node) else 0


def _build3(folder: str, s: int, discount: np.ndarray, hot_back: np.ndarray) -> int:
    """Writes level 3 and removes the counts, which are as large; a repeated task finds the level there."""
    if os.path.exists(f"{folder}/3-{s}"):
        return 0
    trie, (keys, counts), pair_count = opened(folder), _kept(folder, 3, s), _kept(folder, 2, s)[1]
    parent, rank = keys >> trie.rank_bits, keys & ((1 << trie.rank_bits) - 1)
    rest = counts - discount[np.minimum(counts, 3)]
    back = np.maximum(1 - np.bincount(parent, weights=rest, minlength=len(pair_count)) / np.maximum(pair_count, 1), 1e-9)
    middle = trie.level(2, s).all()[1][parent]
    prob = rest / pair_count[parent] + back[parent] * 10 ** trie.ranked(middle, rank)
    Level.write(f"{folder}/3-{s}", len(pair_count), parent, rank, np.log10(prob), np.log10(back))
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{folder}/k3-{s}")
    return 0


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": pdf["shard"][:1], "part": pdf["part"][:1], "block": [pack_keys(*merged(pdf["block"]))]})


def _pass(docs: DataFrame, blocks, build, folder: str, shards: int, parts: int) -> list[tuple[int, ...]]:
    """Count one order over docs; (shard, entries, count, entries seen 1 to 4 times) of each shard. parts: slices, about."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = list(blocks(part.column(0), shards, folder))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = build(folder, int(key[0]), [b for b in pdf["block"] if len(b)])
        return pd.DataFrame([(int(key[0]), *got)], columns=["shard", "n", "total", "n1", "n2", "n3", "n4"])

    counted = texts.mapInArrow(count, "shard int, block binary").withColumn("part", F.spark_partition_id())
    while parts > FAN:
        parts = -(-parts // FAN)
        counted = counted.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("shard", "part").applyInPandas(_combine, "shard int, part int, block binary")
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("block"))
    rows = counted.select("shard", "block").unionByName(every).groupBy("shard").applyInPandas(merge, "shard int, n long, total long, n1 long, n2 long, n3 long, n4 long").collect()
    return sorted(tuple(r) for r in rows)


def _frequent(spark: SparkSession, folder: str, shards: int, more_than: float) -> list[tuple[int, int, int]]:
    """(shard, place there, count) of the words seen more often; no more of them than tokens / more_than."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                count = np.asarray(map_arrays(f"{folder}/1-{s}")["count"])
                at = np.flatnonzero(count > more_than)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(at), s)), "place": pa.array(at), "count": pa.array(count[at])})

    return sorted(tuple(r) for r in spark.range(0, shards, 1, shards).mapInArrow(run, "shard long, place long, count long").collect())


def _level(docs: DataFrame, order: int, blocks, build, folder: str, parts: int) -> tuple[int, list[tuple[int, ...]]]:
    """Count an order, then build its level with the discounts of all shards; the largest number that a build returns, the pass's rows."""
    trie = Trie(folder)
    shards = trie.all_shards
    counted = _pass(docs, blocks, _counts_kept(order), folder, shards, parts)
    discount = discounts([sum(r[k] for r in counted) for k in (3, 4, 5, 6)])
    hot_back = _hot_back(trie, counted, discount) if order == 2 else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"most": pa.array([build(folder, s, discount, hot_back) for s in batch.column(0).to_pylist()], pa.int64())})

    return docs.sparkSession.range(0, shards, 1, shards).mapInArrow(run, "most long").agg(F.max("most")).first()[0], counted


def _write_json(path: str, value) -> None:
    with open(f"{path}.part", "w") as f:
        json.dump(value, f)
    os.replace(f"{path}.part", path)


def train(docs: DataFrame) -> str:
    """Build the trie of the texts in docs; returns its folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    folder, parts = mounted_dir(spark, "ngram"), -(-size // SLICE)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    own = _pass(docs, _unigram_blocks, _build1, folder, shards, parts)
    tokens = sum(r[2] for r in own)
    share = tokens / shards / HOT
    hot = _frequent(spark, folder, shards, share) if tokens else []
    base = np.cumsum([0, *[r[1] for r in own]])
    pieces = [math.ceil(count / share) for _, _, count in hot]
    words = {"hot": [int(base[s]) + place for s, place, _ in hot], "hot_count": [count for _, _, count in hot], "pieces": pieces}
    _write_json(f"{folder}/meta.json", {"shards": shards, "words": [r[1] for r in own], "tokens": tokens} | words)
    most, counted = _level(docs, 2, _bigram_blocks, _build2, folder, parts)
    sizes = [r[1] for r in counted[shards:]]
    ends = np.cumsum(pieces, dtype=np.int64).tolist()
    most = max([most, *[sum(sizes[b - n : b]) for n, b in zip(pieces, ends, strict=True)]])
    _write_json(f"{folder}/ranks.json", {"bits": max(1, most.bit_length()), "sizes": sizes})
    _level(docs, 3, _trigram_blocks, _build3, folder, parts)
    for s in range(shards + len(sizes)):
        os.remove(f"{folder}/k2-{s}")
    return folder


def score_texts(trie: Trie, texts: pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    hashes, tokens, lengths = token_hashes(texts)
    words = trie.words(hashes)
    count, back1 = trie.counts(words)
    uni = trie.unigram(count)
    ids = words[tokens]
    starts = np.cumsum(lengths) - lengths
    before, (shard, place, rank, prob) = distinct_bigrams(trie, ids, lengths, int(words[-1]))
    previous = pairs_of(tokens, lengths, len(words) - 1)
    total = np.where(place >= 0, prob, np.where(before >= 0, back1[previous], 0.0) + uni[tokens])
    # of the pair before: its back-off weight, 0 where the pair isn't stored or the text begins
    weight = np.zeros(len(ids))
    weight[1:] = _context_weights(trie, shard, place)[:-1]
    weight[starts] = 0.0
    total += weight
    at, keys = trigram_keys(place, rank, lengths, trie.rank_bits)
    for s, own in trie.by_shard(shard[at - 1]) if len(at) else ():
        distinct, back = np.unique(keys[own], return_inverse=True)
        level = trie.level(3, s)
        found, _ = level.find(distinct >> trie.rank_bits, distinct & ((1 << trie.rank_bits) - 1))
        hit = found[back] >= 0
        total[at[own[hit]]] = level.prob[found[back][hit]] / -QUANTA
    add = lambda x: np.add.reduceat(x, starts)
    return {"n_tokens": lengths, "n_known": add((count[tokens] > 0).astype(np.int64)), "base_score": add(uni[tokens]), "score": add(total)}


def _context_weights(trie: Trie, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Back-off weight of each token's pair as a context of order 3."""
    out = np.zeros(len(place))
    some = np.flatnonzero(place >= 0)
    for s, at in trie.by_shard(shard[some]):
        out[some[at]] = trie.level(3, s).back[place[some[at]]] / -QUANTA
    return out


def scored(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    held = docs.select("doc_id", held_out(7, 2).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(held.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                trie = opened(folder)
                got = score_texts(trie, part.column(2))
                columns = [part.column(0), part.column(1), got["n_tokens"], got["n_known"], np.full(part.num_rows, trie.total, np.int64), got["base_score"], got["score"]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return held.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out part and score all."""
    return scored(docs, train(docs.where(~held_out(7, 2))))
