"""Relational model of a schema: one table a complex type, simplified by rules and configuration.

A target field knows the path of source fields it came from; the operators build Catalyst expressions
from these paths and the XML writer walks them back.
"""

from __future__ import annotations

import graphlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from xylem.errors import ConfigError
from xylem.functions.names import key_name, link_name, short_name
from xylem.plans.config import checked, column_type, type_length
from xylem.sources.xsd import ComplexType, Field, Schema, SimpleType

#: Base types whose repeated values may be joined to one text.
JOINABLE = ("string", "date", "dateTime", "NMTOKEN", "time", "base64Binary", "decimal")
#: Spark types of built-in types; all others are text.
SPARK_TYPES: dict[str, T.DataType] = (
    dict.fromkeys(("decimal", "float", "double"), T.DoubleType())
    | dict.fromkeys(("integer", "long", "positiveInteger", "negativeInteger", "nonPositiveInteger", "nonNegativeInteger"), T.LongType())
    | dict.fromkeys(("short", "byte"), T.ShortType())
    | {"int": T.IntegerType(), "boolean": T.BooleanType(), "dateTime": T.TimestampType()}
)
#: An optional child with more columns stays a table of its own.
MOST_ELEVATED = 4


@dataclass
class TargetColumn:
    """path: source fields down to the struct that holds the value; leaf: its field, or the branches of a choice."""

    name: str
    type: SimpleType
    occurs: tuple[int, int | None]
    path: tuple[Field, ...]
    leaf: Field | None = None
    branches: tuple[Field, ...] = ()
    options: dict = field(default_factory=dict)

    @property
    def many(self) -> bool:
        return self.occurs[1] != 1

    @property
    def physical(self) -> str:
        return short_name(self.options.get("rename", self.name))

    @property
    def value_type(self) -> T.DataType:
        """Of one value; a configured type wins unless values are joined."""
        if "type" in self.options and not self.many:
            return column_type(self.options["type"])
        return SPARK_TYPES.get(self.type.base, T.StringType())

    @property
    def spark_type(self) -> T.DataType:
        return T.StringType() if self.many else self.value_type

    @property
    def longest(self) -> int:
        """The longest text that the configuration or the schema allows, 1000 if neither says."""
        return type_length(self.options.get("type")) or self.type.max_length or 1000

    def ddl(self) -> str:
        if isinstance(self.spark_type, T.StringType):
            return f"VARCHAR({8000 if self.many else self.longest})"
        return self.spark_type.simpleString().upper()


@dataclass
class Relation:
    """A child table; path as in TargetColumn, leaf: the source field of the child."""

    name: str
    child: Table
    occurs: tuple[int, int | None]
    path: tuple[Field, ...]
    leaf: Field

    @property
    def many(self) -> bool:
        return self.occurs[1] != 1

    def key(self) -> str:
        return short_name(key_name(self.name, self.child.name))


@dataclass(eq=False)
class Table:
    source: ComplexType
    options: dict
    fields: list[TargetColumn | Relation] = field(default_factory=list)
    choice: bool = False
    parents: list[tuple[Table, Relation]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.source.table

    @property
    def physical(self) -> str:
        return short_name(self.name)

    @property
    def reused(self) -> bool:
        return self.options.get("reuse", True) is not False

    @property
    def columns(self) -> list[TargetColumn]:
        return [f for f in self.fields if isinstance(f, TargetColumn)]

    @property
    def relations_1(self) -> list[Relation]:
        return [f for f in self.fields if isinstance(f, Relation) and not f.many]

    @property
    def relations_n(self) -> list[Relation]:
        return [f for f in self.fields if isinstance(f, Relation) and f.many]

    @property
    def primary_key(self) -> str:
        return short_name(f"pk_{self.name}")

    def link_table(self, relation: Relation) -> str:
        return short_name(link_name(self.name, relation.name, relation.child.name))

    def parent_key(self) -> str:
        return short_name(f"fk_parent_{self.parents[0][0].name}")


def _optional(occurs: tuple[int, int | None], through: Field) -> tuple[int, int | None]:
    return (0, occurs[1]) if through.occurs[0] == 0 else occurs


class Model:
    """Source types, target tables in foreign-key order (children first) and texts about them."""

    def __init__(self, xsd: str, short_name: str = "DocumentRoot", config: dict | None = None, base_url: str | None = None, long_name: str = ""):
        self.long_name = long_name or short_name
        self.config = checked(config)
        schema = Schema(xsd, base_url)
        self.root_type, self.files = schema.root(short_name), schema.files
        self.types = self._all_types(self.root_type)
        self.source_tree = "\n".join(self._source_lines(self.root_type, 0, f"{self.root_type.table}:"))
        if self.config.get("as_columnstore") or any(t.get("as_columnstore") for t in self.config["tables"].values()):
            warnings.warn("as_columnstore has no effect: Parquet is columnar", stacklevel=2)
        names = {t.table for t in self.types}
        for name in self.config["tables"]:
            if name not in names:
                raise ConfigError(f"there is no table {name}")
        self._in_many = {id(f.type) for t in self.types for f in t.fields if isinstance(f.type, ComplexType) and f.many}
        self._made: dict[int, Table] = {}
        self.root = self._simplified(self.root_type)
        self.tables = self._ordered()
        self.target_tree = "\n".join(self._target_lines(self.root, 0, f"{self.root.name}:"))
        self._check()

    # model

    @staticmethod
    def _all_types(root: ComplexType) -> list[ComplexType]:
        found: dict[int, ComplexType] = {}

        def visit(t: ComplexType) -> None:
            if id(t) not in found:
                found[id(t)] = t
                for f in t.fields:
                    if isinstance(f.type, ComplexType):
                        visit(f.type)

        visit(root)
        return list(found.values())

    def _options(self, t: ComplexType) -> dict:
        return self.config["tables"].get(t.table) or {"fields": {}}

    def _simplified(self, t: ComplexType) -> Table:
        """Children before their parent, so that a child's size counts what it took over itself."""
        if id(t) in self._made:
            return self._made[id(t)]
        table = self._made[id(t)] = Table(t, self._options(t))
        given = table.options.get("fields", {})
        todo, done = list(t.fields), table.fields
        for f in t.fields:
            if isinstance(f.type, ComplexType):
                self._simplified(f.type)
        while todo:
            f = todo[0]
            how = self._transform(table, f, todo)
            todo.pop(0)
            if how == "skip":
                continue
            if not isinstance(f.type, ComplexType):
                done.append(TargetColumn(f.column, f.type, f.occurs, (), f, options=given.get(f.column, {})))
            elif how in ("elevate", "elevate_wo_prefix"):
                prefix = f"{f.name}_" if how == "elevate" else ""
                for own in self._made[id(f.type)].fields:
                    name, occurs, path = prefix + own.name, _optional(own.occurs, f), (f, *own.path)
                    if isinstance(own, Relation):
                        done.append(Relation(name, own.child, occurs, path, own.leaf))
                    else:
                        done.append(TargetColumn(name, own.type, occurs, path, own.leaf, own.branches, given.get(name, {})))
            else:
                done.append(Relation(f.name, self._made[id(f.type)], f.occurs, (), f))
        self._fold_choice(table)
        return table

    def _transform(self, table: Table, f: Field, todo: list[Field]) -> str | None:
        asked = table.options.get("fields", {}).get(f.column, {}).get("transform")
        one = isinstance(f.type, ComplexType) and not f.many
        if asked is False or asked == "skip":
            return asked or None
        if asked not in (None, "auto"):
            legal = ("elevate", "elevate_wo_prefix") if one else ("join",) if f.many and not isinstance(f.type, ComplexType) else ()
            if asked not in legal:
                raise ConfigError(f"{asked!r} can't be applied to {table.name}.{f.column}")
            if asked == "join" and f.type.base not in JOINABLE:
                raise ConfigError(f"values of {table.name}.{f.column} can't be joined: {f.type.base}")
            return asked
        if asked is None and self.config.get("transform", True) is False:
            return None
        if one and id(f.type) not in self._in_many and (f.occurs[0] == 1 or len(self._made[id(f.type)].columns) <= MOST_ELEVATED):
            columns = len(table.columns) + sum(not isinstance(x.type, ComplexType) for x in todo)
            ones = len(table.relations_1) + sum(isinstance(x.type, ComplexType) and not x.many for x in todo)
            return "elevate_wo_prefix" if not columns and ones == 1 else "elevate"
        return None

    def _fold_choice(self, table: Table) -> None:
        """A choice of like-typed single values becomes type and value: more than two by themselves, fewer if asked."""
        asked = table.options.get("choice_transform", "auto")
        own = [f for f in table.fields if isinstance(f, TargetColumn) and f.leaf is not None and not f.leaf.attribute]
        able = table.source.choice and len(own) == len(table.fields) and len(own) > 0 and len({f.type.base for f in own}) == 1 and not any(f.many or f.path for f in own)
        if asked is True and not able:
            raise ConfigError(f"table {table.name} can't be folded into type and value")
        wanted = asked is True or (asked == "auto" and self.config.get("transform", True) is not False and len(own) > 2)
        if not able or not wanted:
            return
        sizes, longest = [len(f.name) for f in own], [f.type.max_length for f in own]
        kind = SimpleType("string", min(sizes), max(sizes))
        value = SimpleType(own[0].type.base, min(f.type.min_length for f in own), None if None in longest else max(longest))
        branches, given = tuple(f.leaf for f in own), table.options.get("fields", {})
        table.choice = True
        table.fields = [TargetColumn("type", kind, (1, 1), (), None, branches, given.get("type", {})), TargetColumn("value", value, (1, 1), (), None, branches, given.get("value", {}))]

    def _ordered(self) -> list[Table]:
        """Foreign-key order: a table after those it points to; `nested` has them inside out, children before parents."""
        self.nested: list[Table] = []

        def visit(t: Table) -> None:
            if t not in self.nested:
                for f in t.fields:
                    if isinstance(f, Relation):
                        visit(f.child)
                        f.child.parents.append((t, f))
                self.nested.append(t)

        visit(self.root)
        key = lambda t: (t.source.name, t.name)
        made = [t for t in map(self._made.get, map(id, self.types)) if t in self.nested]
        needs: dict[tuple[str, str], set[tuple[str, str]]] = {key(t): set() for t in made}
        for t in made:
            for f in t.fields:
                if isinstance(f, Relation):
                    first, then = (f.child, t) if f.child.reused else (t, f.child)
                    needs[key(then)].add(key(first))
        by_key = {key(t): t for t in made}
        try:
            return [by_key[k] for k in graphlib.TopologicalSorter({k: sorted(v) for k, v in needs.items()}).static_order()]
        except graphlib.CycleError as e:
            raise ConfigError(f"tables need each other: {e.args[1]}") from e

    def _check(self) -> None:
        if not self.root.reused:
            raise ConfigError("the root table can't have reuse: false")
        for t in self.tables:
            if not t.reused and (len(t.parents) != 1 or not t.parents[0][1].many):
                raise ConfigError(f"table {t.name} has reuse: false and needs exactly one parent, which holds a list of it")
            names = [c.physical for c in t.columns]
            if len(set(names)) < len(names):
                raise ConfigError(f"table {t.name} has two columns of one name")

    @property
    def hash_column(self) -> str:
        return self.config.get("record_hash_column_name") or "record_hash"

    @property
    def strict_values(self) -> bool:
        """False if texts that aren't of their type become null instead of failing the load."""
        return self.config.get("bad_values", "error") != "null"

    @property
    def row_numbers(self) -> bool:
        return bool(self.config.get("row_numbers"))

    @property
    def row_number_column(self) -> str:
        """row_numbers may be a name instead of true."""
        asked = self.config.get("row_numbers")
        return asked if isinstance(asked, str) else "row_number"

    @property
    def metadata(self) -> list[tuple[str, T.DataType]]:
        return [(c["name"], column_type(c.get("type", "String"))) for c in self.config.get("metadata_columns") or ()]

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def groups(self) -> list[list[str]]:
        """Tables that are published together: a reused one and the duplicated ones below it."""
        out: dict[str, list[str]] = {}
        for t in reversed(self.tables):
            head = t
            while not head.reused:
                head = head.parents[0][0]
            out.setdefault(head.name, []).append(t.name)
        return [g[::-1] for g in out.values()][::-1]

    # stored tables

    def schemas(self) -> dict[str, T.StructType]:
        """Physical schema of every table and link table, children first."""
        out: dict[str, T.StructType] = {}
        whole = T.LongType()
        for t in self.tables:
            fields = [T.StructField(t.primary_key, whole, False)]
            if not t.reused:
                fields.append(T.StructField(t.parent_key(), whole))
                if self.row_numbers:
                    fields.append(T.StructField(self.row_number_column, T.IntegerType()))
            for f in t.fields:
                if isinstance(f, TargetColumn):
                    fields.append(T.StructField(f.physical, f.spark_type, True, {"occurs": [f.occurs[0], f.occurs[1] or -1]}))
                elif not f.many:
                    fields.append(T.StructField(f.key(), whole))
            if t is self.root:
                fields += [T.StructField(n, k) for n, k in self.metadata]
            if t.reused:
                fields.append(T.StructField(self.hash_column, T.BinaryType()))
            out[t.physical] = T.StructType(fields)
            for r in t.relations_n:
                if r.child.reused:
                    link = [T.StructField(short_name(f"fk_{t.name}"), whole), T.StructField(short_name(f"fk_{r.child.name}"), whole)]
                    out[t.link_table(r)] = T.StructType([*link, *([T.StructField(self.row_number_column, T.IntegerType())] if self.row_numbers else [])])
        return out

    # texts

    def _source_lines(self, t: ComplexType, depth: int, head: str) -> Iterator[str]:
        yield " " * 4 * depth + head
        for f in t.fields:
            if isinstance(f.type, ComplexType):
                mark = " (choice)" if f.type.choice else ""
                yield from self._source_lines(f.type, depth + 1, f"{f.name}[{f.occurs[0]}, {f.occurs[1]}]{mark}:")
            else:
                yield " " * 4 * (depth + 1) + f"{f.column}[{f.occurs[0]}, {f.occurs[1]}]: {f.type.base}"

    def _target_lines(self, t: Table, depth: int, head: str) -> Iterator[str]:
        yield " " * 4 * depth + head
        for f in t.fields:
            if isinstance(f, Relation):
                mark = " (choice)" if f.child.source.choice and not f.child.choice else ""
                yield from self._target_lines(f.child, depth + 1, f"{f.name}[{f.occurs[0]}, {f.occurs[1]}]{mark}:")
            else:
                yield " " * 4 * (depth + 1) + f"{f.name}[{f.occurs[0]}, {f.occurs[1]}]: {f.type.base}"

    def erd(self, physical: bool = False) -> str:
        """Mermaid entity-relationship diagram."""
        clean = lambda s: s.replace(".", "_")
        name = lambda t: clean(t.physical if physical else t.name)
        out = ["```mermaid", "erDiagram"]
        own_first = lambda rs: sorted(rs, key=lambda r: bool(r.path))
        for t in reversed(self.tables):
            for r in own_first(t.relations_1):
                out.append(f'    {name(t)} ||--{"||" if r.occurs[0] else "o|"} {name(r.child)} : "{clean(r.name)}"')
            for r in own_first(t.relations_n):
                star = "*" if r.child.reused else ""
                out.append(f'    {name(t)} ||--{"|{" if r.occurs[0] else "o{"} {name(r.child)} : "{clean(r.name)}{star}"')
            out.append(f"    {name(t)} {{")
            for c in t.columns:
                out.append(f"        {c.type.base}{'-N' if c.occurs[1] is None else ''} {clean(c.physical if physical else c.name)}")
            out.append("    }")
        return "\n".join([*out, "```"])

    def create_statements(self, schema: str | None = None) -> list[str]:
        """Spark SQL for every table, children first."""
        quote = lambda s: f"`{s.replace('`', '``')}`"
        lengths = {(t.physical, c.physical): c.ddl() for t in self.tables for c in t.columns}
        out = []
        for name, struct in self.schemas().items():
            columns = [f"  {quote(f.name)} {lengths.get((name, f.name), f.dataType.simpleString().upper())}{'' if f.nullable else ' NOT NULL'}" for f in struct]
            where = f"{quote(schema)}." if schema else ""
            out.append(f"CREATE TABLE IF NOT EXISTS {where}{quote(name)} (\n" + ",\n".join(columns) + "\n) USING parquet")
        return out

    def index_hints(self) -> list[dict[str, Any]]:
        """What a store may sort or bucket by: hashes and keys, and the tables' extra_args."""
        out: list[dict[str, Any]] = []
        for t in self.tables:
            if t.reused:
                out.append({"table": t.physical, "columns": [self.hash_column], "unique": True})
            else:
                out.append({"table": t.physical, "columns": [t.parent_key()], "unique": False})
            out += [{"table": t.link_table(r), "columns": [short_name(f"fk_{t.name}")], "unique": False} for r in t.relations_n if r.child.reused]
            extra = t.options.get("extra_args")
            extra = extra(t) if callable(extra) else extra
            out += [{"table": t.physical, "extra": x} for x in extra or ()]
        return out
