"""SimHash near-duplicates: 64-bit fingerprints, one-wildcard segment variants, verified links, components.

Fingerprint: over the XXH64 hashes (UTF-8, seed 42) of a text's 3-word shingles, a bit is 1 if more
than half of the hashes have it. Two fingerprints link at 3 or fewer differing bits.

Search: a fingerprint is cut into two 32-bit segments. Of 3 differing bits one segment has at most
one, so both fingerprints share a variant of that segment with one bit wiped out. Each distinct
fingerprint is indexed under its 64 variants, variants are joined by equality and every candidate is
verified; a link is emitted only under the first variant that finds it. A variant that many
fingerprints share is cut again: of the other segment's two 16-bit quarters one also differs by at
most one bit, which gives 32 finer keys. Both cuts are exact; nothing is capped.

Copies collapse to one fingerprint before any join, so a group of equal texts costs one entry
whatever its size. Components come from alternating star contractions, each written to the shared
folder; nothing is collected.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text of
one or two words has one shingle; a null doc_id takes part and gets the component's smallest doc_id
(null if it has none); repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm.common import OWN, materialise

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: A variant with more distinct fingerprints than this is cut again. Speed only: results don't depend on it.
HOT_VARIANT = 256
#: The rows of one node or component are spread over this many slots before a join.
SLOTS = 64
FP = f"{OWN}fp"
#: SPREAD[b] holds the 8 bits of byte b, highest first, in the 8 bytes of a 64-bit integer.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).copy().view(np.uint64).ravel()
#: Hashes that can be added in bytes without overflow, and hashes counted at once.
LANE, BLOCK = 255, 1 << 16


def shingle_digests(text: bytes) -> bytes:
    """The big-endian XXH64 digests of a text's shingles, joined."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)])


def fingerprints(digests: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprints from the joined digests of each text."""
    counts = np.array([len(d) >> 3 for d in digests], dtype=np.int64)
    votes = np.zeros((len(digests), 64), dtype=np.int64)
    data, filled = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), np.concatenate([[0], np.cumsum(counts)])
    some = np.flatnonzero(counts)
    # groups of at most LANE hashes of one text: lane sums fit a byte
    pieces = -(-counts[some] // LANE)
    owner = np.repeat(some, pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = filled[owner] + nth * LANE
    for a in range(0, len(owner), max(1, BLOCK // 64)):
        b = min(len(owner), a + max(1, BLOCK // 64))
        low, high = starts[a], filled[-1] if b == len(owner) else starts[b]
        sums = np.add.reduceat(SPREAD[data[low:high]], starts[a:b] - low, axis=0)
        np.add.at(votes, owner[a:b], sums.view(np.uint8).reshape(b - a, 64))
    bits = np.packbits(2 * votes > counts[:, None], axis=1)
    return bits.view(">i8").ravel().astype(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs and the fingerprint as a long column FP."""
    keep = docs.columns if keep is None else keep
    # a kept text goes to Python once
    place = keep.index(text) if text in keep and isinstance(docs.schema[text].dataType, T.StringType) else len(keep)
    held = docs.select(*keep, *([docs[text].cast("string").alias(f"{OWN}t")] if place == len(keep) else []))
    schema = T.StructType([*held.schema.fields[: len(keep)], T.StructField(FP, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests, size = [], [], 0
            for text in batch.column(place).cast(pa.binary()):
                digests.append(shingle_digests(text.as_py() or b""))
                size += len(digests[-1])
                if size > 8 * 200_000:
                    out.append(fingerprints(digests))
                    digests, size = [], 0
            if digests:
                out.append(fingerprints(digests))
            found = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, FP])

    return held.mapInArrow(run, schema)


def _variants(nodes: DataFrame) -> DataFrame:
    """64 rows for each fingerprint: variant position, its key, the fingerprint."""
    half = "CASE WHEN pos < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END"
    keyed = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    return keyed.select("fp", "pos", F.expr(f"shiftleft(cast(pos AS bigint), 32) | (({half}) & ~shiftleft(1L, pos & 31))").alias("key"))


def _finer(keyed: DataFrame) -> DataFrame:
    """32 rows for each row: one-wildcard variants of the 16-bit quarters of the other segment."""
    other = "CASE WHEN pos < 32 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END"
    wide = keyed.select("*", F.expr(other).alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("sub"))
    quarter = "CASE WHEN sub < 16 THEN shiftrightunsigned(other, 16) ELSE other & 65535 END"
    return wide.select("fp", "pos", "key", "sub", F.expr(f"shiftleft(cast(sub AS bigint), 16) | (({quarter}) & ~shiftleft(1L, sub & 15))").alias("subkey"))


#: Of the variants in which two fingerprints meet, true for the first only. x: their difference.
_FIRST = "CASE WHEN pos < 32 THEN shiftrightunsigned(x, 32) <> 0 OR pos = 0 ELSE bit_count(shiftrightunsigned(x, 32)) > 1 AND ((x & 4294967295) <> 0 OR pos = 32) END"
_OTHER = "CASE WHEN pos < 32 THEN x & 4294967295 ELSE shiftrightunsigned(x, 32) END"
_FIRST_SUB = f"CASE WHEN sub < 16 THEN shiftrightunsigned({_OTHER}, 16) <> 0 OR sub = 0 ELSE bit_count(shiftrightunsigned({_OTHER}, 16)) > 1 AND ((({_OTHER}) & 65535) <> 0 OR sub = 16) END"


def _meet(keyed: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Verified links (u < v) among rows with equal keys. Spark takes a table for no larger before its rows
    are multiplied by explode, and would broadcast all variants: the hint keeps them off the driver."""
    left, right = keyed.withColumnRenamed("fp", "u"), keyed.select(F.col("fp").alias("v"), *[F.col(k).alias(f"r_{k}") for k in keys])
    condition = F.col("u") < F.col("v")
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"r_{k}"))
    condition = condition & F.expr(f"bit_count(u ^ v) <= {MOST_BITS}") & F.expr(re.sub(r"\bx\b", "(u ^ v)", first))
    return left.join(right.hint("merge"), condition).select("u", "v")


def links(nodes: DataFrame, hot_variant: int = HOT_VARIANT) -> DataFrame:
    """All pairs u < v of the distinct fingerprints `nodes` (column fp) at MOST_BITS or fewer bits, once each."""
    keyed = _variants(nodes)
    hot = materialise(keyed.groupBy("key").count().where(F.col("count") > hot_variant).select("key"), "hot-variants")
    if hot.isEmpty():
        return _meet(keyed, ["key"], _FIRST)
    cool = keyed.join(hot, "key", "left_anti")
    finer = _finer(keyed.join(hot, "key", "left_semi"))
    return _meet(cool, ["key"], _FIRST).unionByName(_meet(finer, ["key", "subkey"], f"({_FIRST}) AND ({_FIRST_SUB})"))


def _with_lowest(rows: DataFrame, node: str, value: str, by: str | None = None) -> DataFrame:
    """rows and, as m, the smallest value of its node. A node's rows are never brought together: each of
    its slots, which rows are spread over by the hash of `by` (the value), is joined by itself. Nothing
    here is broadcast: edges and slots grow with the input and the driver's memory doesn't."""
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64(by or value), F.lit(SLOTS)))
    slots = slotted.groupBy(node, "slot").agg(F.min(value).alias("m"))
    lowest = slots.groupBy(node).agg(F.min("m").alias("m"))
    return slotted.join(slots.select(node, "slot").join(lowest.hint("merge"), node).hint("merge"), [node, "slot"]).drop("slot")


def star_roots(edges: DataFrame) -> DataFrame:
    """(v, root): for each node that has an edge (u, v) and isn't its component's smallest, that smallest node.

    Large-star hangs a node's larger neighbours below its smallest one, small-star does so with the
    smaller ones; repeated until nothing changes.
    """
    edges, before = edges.where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v"), None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        hung = _with_lowest(both, "u", "v").withColumn("m", F.least("u", "m"))
        edges = hung.where("v > u AND v <> m").selectExpr("m AS u", "v").distinct()
        edges = _with_lowest(edges, "v", "u").selectExpr("m AS u", "explode(array(u, v)) AS v").where("u <> v").distinct()
        edges = materialise(edges, "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.selectExpr("v", "u AS root")
        before = now


def with_component(rows: DataFrame, doc_id: str = "doc_id", hot_variant: int = HOT_VARIANT) -> DataFrame:
    """rows (doc_id, FP) to (FP, rep, component): the smallest doc_id with this fingerprint and in its component."""
    reps = materialise(rows.groupBy(F.col(FP).alias("fp")).agg(F.min(doc_id).alias("rep")), "fingerprints")
    roots = star_roots(materialise(links(reps.select("fp"), hot_variant), "links"))
    placed = reps.join(roots.hint("merge"), F.col("fp") == F.col("v"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return _with_lowest(placed, "root", "rep", by="fp").select(F.col("fp").alias(FP), "rep", F.col("m").alias("component"), "root")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs."""
    rows = materialise(with_fingerprint(docs, keep=["doc_id"]), "simhash")
    hex16 = F.lpad(F.lower(F.hex(FP)), 16, "0")
    # components, one for each fingerprint, grow with the input: not broadcast even where Spark measures them as small
    return rows.join(with_component(rows).select(FP, "component").hint("merge"), FP, "left").select("doc_id", hex16.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (nulls last; of repeated rows one), unchanged."""
    rid = f"{OWN}rid"
    rows = materialise(with_fingerprint(docs.withColumn(rid, F.monotonically_increasing_id())), "simhash")
    ids = rows.select("doc_id", rid, FP)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(rid).alias("r"))
    mine = ids.groupBy(FP).agg(F.min(order).alias("first"))
    placed = mine.join(with_component(ids).select(FP, "root"), FP)
    winners = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.r").alias(rid))
    # hashed, not sorted: only ids are held, the texts stream past them
    return rows.join(winners.hint("shuffle_hash"), rid, "left_semi").select(*docs.columns)
