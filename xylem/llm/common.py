"""What the operators of this subpackage share: words, the shared folder, materialised tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII white space only.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefix of the columns that operators add for themselves; a caller's column never clashes with it.
OWN = "__xylem_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on one machine where none is set (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_.get() if set_.isDefined() else spark.conf.get("xylem.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="xylem-")
        spark.conf.set("xylem.shared.dir", root)
    return root.rstrip("/")


_RUNS: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is deleted when the driver's Python ends: results may read it till then."""
    path = f"{checkpoint_root(spark)}/xylem-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        shutil.rmtree(uri.path, ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the JVM may be gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the application's folder; nothing is created yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def mounted_dir(spark: SparkSession, label: str) -> str:
    """A new folder as a path that every machine can open.

    The operators that write files of their own format (archives, tries) need the shared folder
    mounted; with an object store only Spark can open, they say so instead of writing locally.
    """
    uri = urlparse(shared_dir(spark, label))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted (file:) folder for {label}: {uri.geturl()}")
    os.makedirs(uri.path, exist_ok=True)
    return uri.path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pinned(column: Column) -> Column:
    """A long column plus floor(rand()), which is always 0.

    Catalyst doesn't move a filter below a projection that isn't deterministic, so what the column is
    made of is evaluated once and isn't written out again within the filter.
    """
    return (column + F.floor(F.rand()).cast("long")).cast("long")


def words(text: Column) -> Column:
    """Words of a text as an array; none for an empty or blank text."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True where crc32 of the id as text has this remainder; ids that are null count as the text ''."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(modulus)) == remainder


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words in order) of lower-cased (A-Z) texts; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    values, offsets = lists.values, lists.offsets.to_numpy()
    kept = pc.greater(pc.binary_length(values), 0)
    seen = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.diff(seen[offsets]), values.filter(kept)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20):
    """Cut a record batch into runs of rows whose texts hold about `most_bytes`; a longer text stays whole.

    The runs are copies: Arrow's split and lower functions go wrong on slices that were cast.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.take(pa.array(np.arange(start, stop))) if start or stop < batch.num_rows else batch
        start = stop
