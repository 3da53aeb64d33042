"""Token ids of texts by a public byte-level BPE.

Words between single blanks are encoded once for each distinct word of a batch. That equals encoding the
text at once as no piece of the pattern spans a blank between two non-blank characters; texts with
other runs of white space next to a blank are encoded whole.

The tokenizer's file is read by the driver and broadcast (its size is checked); its path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_RANKS_BYTES = 64 << 20

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(ranks: bytes) -> tiktoken.Encoding:
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def read_ranks(path: str = RANKS) -> bytes:
    if os.path.getsize(path) > MOST_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANKS_BYTES} bytes; it would be broadcast")
    with open(path, "rb") as f:
        return f.read()


def _pieces(encoding: tiktoken.Encoding, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each piece): one call over the pieces joined by line ends.

    A line end before a blank or a visible character is a token of its own, so the joined text encodes
    as its pieces do. Pieces that hold white space besides a first blank are encoded alone.
    """
    mark = encoding.encode_ordinary("\n")
    plain = [k for k, p in enumerate(pieces) if len(p.split()) == 1 and not p[-1].isspace() and not p[1:2].isspace() and not (p[0].isspace() and p[0] != " ")]
    size, parts = np.zeros(len(pieces), np.int64), [np.empty(0, np.int64)] * len(pieces)
    if plain and len(mark) == 1:
        ids = encoding.encode_to_numpy("\n".join([pieces[k] for k in plain]), disallowed_special=()).astype(np.int64)
        cuts = np.flatnonzero(ids == mark[0])
        begins, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
        size[plain] = ends - begins
    else:
        plain, ids = [], np.empty(0, np.int64)
    alone = np.ones(len(pieces), bool)
    alone[plain] = False
    if not alone.any():
        return ids[ids != mark[0]], size
    for k in np.flatnonzero(alone).tolist():
        parts[k] = np.array(encoding.encode_ordinary(pieces[k]), np.int64)
        size[k] = len(parts[k])
    flat, start = np.empty(int(size.sum()), np.int64), np.cumsum(size) - size
    n = size[plain]
    if len(plain):
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(start[plain], n) + inside] = ids[ids != mark[0]]
    for k in np.flatnonzero(alone).tolist():
        flat[start[k] : start[k] + size[k]] = parts[k]
    return flat, size


def encoded(encoding: tiktoken.Encoding, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, all ids)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    # a blank next to another white-space character, or at an end: such texts are encoded whole
    whole = pc.match_substring_regex(texts, r"(?: [\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |^ | $)").to_numpy(zero_copy_only=False)
    spaced = np.flatnonzero(~whole)
    lists = pc.split_pattern(texts.take(pa.array(spaced)), " ")
    offsets = lists.offsets.to_numpy()
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy().astype(np.int64)
    # the first word of a text has no blank before it
    first = np.zeros(len(index), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    kinds, kind = np.unique(index * 2 + first, return_inverse=True)
    flat, size = _pieces(encoding, [words[k >> 1] if k & 1 else " " + words[k >> 1] for k in kinds.tolist()])
    start = np.cumsum(size) - size
    each = size[kind]
    at = np.repeat(start[kind] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    spaced_ids, filled = flat[at], np.concatenate([[0], np.cumsum(each)])
    count = np.zeros(len(texts), np.int64)
    count[spaced] = np.diff(filled[offsets])
    if not whole.any():
        return count, spaced_ids
    parts, begin = [None] * len(texts), filled[offsets]
    for k, row in enumerate(spaced.tolist()):
        parts[row] = spaced_ids[begin[k] : begin[k + 1]]
    for row in np.flatnonzero(whole).tolist():
        parts[row] = np.array(encoding.encode_ordinary(texts[row].as_py()), np.int64)
        count[row] = len(parts[row])
    return count, np.concatenate(parts)
