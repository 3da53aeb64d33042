"""Incremental merge of staged records: rows are only added, equal records never twice.

Shared records are new if the table has no such hash. Children of their own parent, and links, are
added with parents that are new in this load and left out with known ones. Whole-number keys are
given out at the end: rows are numbered within buckets of their hash and buckets are shifted by the
counts before them, so numbering needs neither one task nor the driver for the rows.
"""

from __future__ import annotations

import random
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.errors import ConflictError
from xylem.functions.names import short_name
from xylem.operators.flatten import KEY, PARENT, ROW, Staged
from xylem.plans.model import Table
from xylem.sources.store import ParquetStore

#: Hex digits of a key that make its bucket: 16 ** BUCKET_DIGITS counts are the most that are summed in one place.
BUCKET_DIGITS = 3
PK, NEW = "pk__", "new__"


@dataclass
class MergeStats:
    """Rows of each table that were added, and shared rows that were there."""

    inserted: dict[str, int] = field(default_factory=dict)
    existing: dict[str, int] = field(default_factory=dict)


@dataclass
class LoadStats(MergeStats):
    duration_temp_insert: float = 0.0
    duration_merge: float = 0.0
    duration_cleanup: float = 0.0
    stats_available: bool = True
    #: Texts that weren't of their type and became null (configuration bad_values: null).
    lost_values: int = 0


def numbered(rows: DataFrame, first: int | Column, key: str = KEY, out: str = PK) -> DataFrame:
    """Add consecutive whole numbers from `first`, in the order of the hex key."""
    rows = rows.withColumn("bucket__", F.substring(F.col(key), 1, BUCKET_DIGITS))
    counts = rows.groupBy("bucket__").agg(F.count(F.lit(1)).alias("count__"))
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("bucket__", F.coalesce(F.sum("count__").over(before), F.lit(0)).alias("shift__"))
    place = F.row_number().over(Window.partitionBy("bucket__").orderBy(key))
    start = first if isinstance(first, Column) else F.lit(first)
    counted = rows.withColumn("place__", place).join(F.broadcast(shifts), "bucket__")
    return counted.withColumn(out, (start + F.col("shift__") + F.col("place__") - 1).cast("long")).drop("bucket__", "place__", "shift__")


class Merge:
    """One load into a store."""

    def __init__(self, staged: Staged, store: ParquetStore):
        self.staged, self.model, self.store = staged, staged.model, store
        self.schemas = staged.model.schemas()
        self.keys: dict[str, DataFrame] = {}
        self.load, self.first, self.tops = store.begin(), not store.loads(), store.tops()
        self.stats = MergeStats()

    def _next(self, t: Table) -> int:
        return self.tops.get(t.physical, 0) + 1

    def _with_children(self, t: Table, rows: DataFrame) -> DataFrame:
        """Replace only children's hashes by their keys."""
        for r in t.relations_1:
            keys = self.keys[r.child.name].select(F.col(KEY).alias("child__"), F.col(PK).alias("child_pk__"))
            rows = rows.join(keys, F.col(f"`{r.key()}`") == F.col("child__"), "left")
            rows = rows.withColumn(r.key(), F.col("child_pk__")).drop("child__", "child_pk__")
        return rows

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schemas[name]]
        done = self.store.append(self.load, name, rows.select(*columns, *[F.col(c) for c in (KEY, PARENT) if c in rows.columns]))
        self.stats.inserted[name] = done.count()
        self.tops[name] = self.tops.get(name, 0) + self.stats.inserted[name]
        return done

    def _shared(self, t: Table) -> None:
        if self.first:
            self.keys[t.name] = self._add_shared(t, self.staged.records(t))
            self.stats.existing[t.physical] = 0
            return
        old = self.store.read(t.physical, self.schemas[t.physical]).select(F.lower(F.hex(f"`{self.model.hash_column}`")).alias(KEY), F.col(f"`{t.primary_key}`").alias(PK))
        known = old.join(self.staged.keys(t), KEY, "left_semi").withColumn(NEW, F.lit(False))
        known = self.store.aside(self.load, t.physical, known)  # the table is read once
        self.stats.existing[t.physical] = known.count()
        written = self._add_shared(t, self.staged.records(t).join(known, KEY, "left_anti"))
        self.keys[t.name] = written.unionByName(known)

    def _add_shared(self, t: Table, records: DataFrame) -> DataFrame:
        """Number and write records; KEY, PK and NEW."""
        new = self._with_children(t, numbered(records, self._next(t)))
        new = new.withColumn(t.primary_key, F.col(PK)).withColumn(self.model.hash_column, F.unhex(KEY))
        return self._write(t.physical, new).select(KEY, F.col(f"`{t.primary_key}`").alias(PK), F.lit(True).alias(NEW))

    def _owned(self, t: Table) -> None:
        parent, _ = t.parents[0]
        keys = self.keys[parent.name].where(NEW).select(F.col(KEY).alias(PARENT), F.col(PK).alias("parent_pk__"))
        new = self._with_children(t, numbered(self.staged.records(t).join(keys, PARENT), self._next(t)))
        new = new.withColumn(t.primary_key, F.col(PK)).withColumn(t.parent_key(), F.col("parent_pk__")).withColumn(self.model.row_number_column, F.col(ROW))
        written = self._write(t.physical, new)
        self.keys[t.name] = written.select(KEY, F.col(f"`{t.primary_key}`").alias(PK), F.lit(True).alias(NEW))

    def _links(self, t: Table) -> None:
        for r in t.relations_n:
            if r.child.reused:
                name = t.link_table(r)
                parents = self.keys[t.name].where(NEW).select(F.col(KEY).alias(PARENT), F.col(PK).alias(short_name(f"fk_{t.name}")))
                children = self.keys[r.child.name].select(KEY, F.col(PK).alias(short_name(f"fk_{r.child.name}")))
                rows = self.staged.links[name].join(parents, PARENT).join(children, KEY).withColumn(self.model.row_number_column, F.col(ROW))
                self._write(name, rows)

    def run(self) -> MergeStats:
        """Add what is new, all tables or none."""
        try:
            for t in self.model.tables:
                self._shared(t) if t.reused else self._owned(t)
            for t in self.model.tables:
                self._links(t)
            self.store.commit(self.load, self.schemas, self.tops)
        except BaseException:
            self.store.abort(self.load, self.schemas)
            raise
        return self.stats


def merge(staged: Staged, store: ParquetStore, tries: int = 20) -> LoadStats:
    """Merge staged records and time it; a load that another overtook is merged again with what is there then."""
    began = time.monotonic()
    store.create(staged.model.schemas())
    for k in range(tries):
        try:
            done = Merge(staged, store).run()
            break
        except ConflictError:
            if k == tries - 1:
                raise
            time.sleep(random.random() * min(2**k, 30) / 4)
    return LoadStats(done.inserted, done.existing, duration_merge=time.monotonic() - began)

