"""Target structs to linked flat tables, equal records once.

Until records are merged every link is a key made of hashes: the subtree hash for shared records, a
hash of parent key, field and place for records of their own parent. Links and records of their own
parent are opened from parents that are distinct. Documents are made distinct when they are staged, so
that nothing moves whole documents; records and shared children are opened from all parents and made
distinct as flat rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.functions.text import join_values
from xylem.operators.shape import HASH
from xylem.plans.model import Model, Relation, Table

KEY, PARENT, ROW, NODE = "k__", "p__", "row__", "n__"


@dataclass
class Staged:
    """nodes: KEY, NODE (PARENT and ROW where the table isn't shared) of each table; links: PARENT, KEY, ROW.

    opened: the nodes with repeats.
    """

    model: Model
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    opened: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[str, DataFrame] = field(default_factory=dict)
    #: (table name, records) -> records, after hashing; keys must stay.
    hook: Callable[[str, DataFrame], DataFrame] | None = None

    def records(self, table: Table) -> DataFrame:
        """Typed columns of a table; the key of an only child stands in its foreign key column."""
        rows = self.opened[table.name]
        columns: list[Column] = [F.col(c) for c in rows.columns if c != NODE]
        for f in table.fields:
            value = F.col(NODE)[f.name]
            if isinstance(f, Relation):
                if not f.many:
                    columns.append(value[HASH].alias(f.key()))
            else:
                columns.append((join_values(value) if f.many else value.cast(f.spark_type)).alias(f.physical))
        records = self._once(table, rows.select(*columns))
        return self.hook(table.name, records) if self.hook else records

    def _once(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows of opened nodes, one a key."""
        if self.opened[table.name] is self.nodes[table.name]:
            return rows
        return each_once(rows) if table is not self.model.root else rows.dropDuplicates([KEY])

    def keys(self, table: Table) -> DataFrame:
        """KEY of each record."""
        if self.hook:
            return self.records(table).select(KEY)
        keys = self.opened[table.name].select(KEY)
        return keys if self.opened[table.name] is self.nodes[table.name] else keys.distinct()

    def counts(self) -> dict[str, int]:
        return {t.name: self.keys(t).count() for t in self.model.tables}


def child_key(parent: Column, name: str, place: Column) -> Column:
    return F.sha1(F.concat(parent, F.lit(f"/{name}/"), place.cast("string")).cast("binary"))


def each_once(rows: DataFrame) -> DataFrame:
    """Rows that often repeat, one a key: equal ones are dropped by hash before those that differ in their children's order are sorted."""
    return rows.distinct().dropDuplicates([KEY])


def stage(docs: DataFrame, folder: str) -> DataFrame:
    """Write documents and read them back."""
    docs.write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(docs.schema).parquet(folder)


def distinct_documents(docs: DataFrame, folder: str, doc: str = "doc") -> DataFrame:
    """Staged documents, one a hash. Where none repeats, as hashes alone can tell, these are the documents; else they are written to the folder."""
    there = docs.where(F.col(doc).isNotNull())
    again = there.groupBy(F.xxhash64(F.col(doc)[HASH]).alias(KEY)).count().where("count > 1")
    if again.isEmpty():
        return docs
    return stage(there.withColumn(KEY, F.col(doc)[HASH]).dropDuplicates([KEY]).drop(KEY), folder)


def _children(parents: DataFrame, relation: Relation) -> DataFrame:
    """PARENT, ROW (from 1), NODE of a list of children."""
    rows = parents.select(F.col(KEY).alias(PARENT), F.posexplode(F.col(NODE)[relation.name]).alias(ROW, NODE))
    return rows.withColumn(ROW, F.col(ROW) + 1)


def flattened(model: Model, docs: DataFrame, doc: str = "doc", metadata: list[str] | None = None, distinct: bool = False) -> Staged:
    """Take shaped documents apart. metadata: columns of docs that the root table keeps. distinct: no two documents have the same hash."""
    staged, metadata = Staged(model), metadata or []
    roots = docs.where(F.col(doc).isNotNull()).select(F.col(doc)[HASH].alias(KEY), F.col(doc).alias(NODE), *metadata)
    staged.opened[model.root.name] = roots
    staged.nodes[model.root.name] = roots if distinct else roots.dropDuplicates([KEY])
    found: dict[str, list[DataFrame]] = {}
    for t in reversed(model.nested):
        if t is not model.root:
            parts = found.get(t.name, [])
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            staged.opened[t.name] = rows
            staged.nodes[t.name] = each_once(rows) if t.reused else rows
        own, every = staged.nodes[t.name], staged.opened[t.name]
        for r in t.relations_1:
            only = every.select(F.col(NODE)[r.name].alias(NODE)).where(F.col(NODE).isNotNull())
            found.setdefault(r.child.name, []).append(only.select(F.col(NODE)[HASH].alias(KEY), NODE))
        for r in t.relations_n:
            rows = _children(own, r)
            if r.child.reused:
                rows = rows.withColumn(KEY, F.col(NODE)[HASH])
                staged.links[t.link_table(r)] = rows.select(PARENT, KEY, ROW)
                each = every.select(F.explode(F.col(NODE)[r.name]).alias(NODE))
                found.setdefault(r.child.name, []).append(each.select(F.col(NODE)[HASH].alias(KEY), NODE))
            else:
                rows = rows.withColumn(KEY, child_key(F.col(PARENT), r.name, F.col(ROW)))
                found.setdefault(r.child.name, []).append(rows.select(KEY, PARENT, ROW, NODE))
    return staged
