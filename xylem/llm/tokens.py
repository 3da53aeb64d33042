"""Token ids in packed binary matrices.

Texts are encoded by a public byte-level BPE. Documents longer than a row are cut into full pieces and
a rest, pieces are packed longest first into the row with the least room that fits (a segment tree
over the rooms finds it), and each row is written as little-endian ids filled up with the pad id,
with the cumulative segment lengths, the places where positions start again at 0 and the document
and start of each segment, so that every document can be put together again.

Rows are packed within groups of input partitions as in packing.py: no shuffle, bounded memory. Files
are in the mounted shared folder; each attempt of a task writes files of its own and renames them into
place when whole, all attempts write the same bytes. The query's rows are read back from the files.

Defined cases: a null or empty text has no tokens and no segment; repeated rows are packed each; ties are
placed in input order; very long texts fill many rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from xylem.llm import bpe, packing
from xylem.llm.common import materialise, mounted_dir

LENGTH = 2048
SUFFIXES = ("ids.bin", "cu.bin", "resets.bin", "rows.bin", "docs.arrow")


def packed(docs: DataFrame, ranks: str = bpe.RANKS, length: int = LENGTH, pad: int = packing.PAD, group: int = packing.GROUP) -> DataFrame:
    """One row for each matrix row: the columns of packing.packed without the capacity, which is `length`."""
    return packing.packed(docs, (length,), ranks, pad, group).drop("capacity")


def write_matrices(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write each partition of packed rows as raw files in the mounted shared folder; (path, rows).

    <path>.ids.bin: the id matrix; <path>.cu.bin and <path>.resets.bin: int32, all rows joined;
    <path>.rows.bin: int64 pairs, the ends of each row in those two; <path>.docs.arrow: an Arrow stream
    of seq_id, n_tokens, doc_ids and doc_starts.
    """
    folder = folder or mounted_dir(rows.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, own = f"{folder}/part-{TaskContext.get().partitionId():06d}", f".{uuid.uuid4().hex}"
        ends, n, docs = np.zeros(2, np.int64), 0, None
        files = [open(f"{path}.{s}{own}", "wb") for s in SUFFIXES]  # noqa: SIM115
        for batch in batches:
            for ids in batch.column("ids"):
                files[0].write(ids.as_buffer())
            sizes = []
            for k, name in ((1, "cu_seqlens"), (2, "resets")):
                column = batch.column(name)
                files[k].write(column.flatten().to_numpy().astype("<i4").tobytes())
                sizes.append(column.value_lengths().to_numpy())
            each = ends + np.cumsum(np.stack(sizes, axis=1), axis=0)
            files[3].write(each.astype("<i8").tobytes())
            ends = each[-1] if len(each) else ends
            kept = batch.select(["seq_id", "n_tokens", "doc_ids", "doc_starts"])
            docs = docs or pa.ipc.new_stream(files[4], kept.schema)
            docs.write_batch(kept)
            n += batch.num_rows
        if docs:
            docs.close()
        for f, s in zip(files, SUFFIXES, strict=True):
            f.close()
            if n:
                os.replace(f.name, f"{path}.{s}")
            else:
                os.remove(f.name)
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "rows": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "path string, rows long")


def read_matrices(written: DataFrame, doc_type: str = "bigint", length: int = LENGTH) -> DataFrame:
    """The packed rows of written files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.memmap(f"{path}.ids.bin", np.uint8, "r").reshape(rows, -1)
                if ids.shape[1] not in (2 * length, 4 * length):
                    raise ValueError(f"{path}: {rows} rows of {length} ids were written")
                cu, resets = (np.fromfile(f"{path}.{s}", "<i4") for s in ("cu.bin", "resets.bin"))
                ends = np.concatenate([np.zeros((1, 2), np.int64), np.fromfile(f"{path}.rows.bin", "<i8").reshape(-1, 2)])
                at = 0
                with pa.OSFile(f"{path}.docs.arrow") as source:
                    for docs in pa.ipc.open_stream(source):
                        own = ends[at : at + docs.num_rows + 1]
                        part = lambda values, k: pa.ListArray.from_arrays(pa.array(own[:, k] - own[0, k], pa.int32()), pa.array(values[own[0, k] : own[-1, k]], pa.int32()))  # noqa: B023, E731
                        places = np.arange(docs.num_rows + 1, dtype=np.int32) * ids.shape[1]
                        matrix = pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer(places), pa.py_buffer(np.array(ids[at : at + docs.num_rows]))])
                        yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), matrix, part(cu, 0), part(resets, 1), docs.column(2), docs.column(3)], names=[n for n in packing.NAMES if n != "capacity"])
                        at += docs.num_rows

    return written.repartition(max(1, written.count())).mapInArrow(run, packing.COLUMNS.format(doc=doc_type).replace("capacity int, ", ""))


def matrices(docs: DataFrame, ranks: str = bpe.RANKS, length: int = LENGTH) -> DataFrame:
    """Pack, write and read back."""
    return read_matrices(materialise(write_matrices(packed(docs, ranks, length)), "matrices"), dict(docs.dtypes)["doc_id"], length)
