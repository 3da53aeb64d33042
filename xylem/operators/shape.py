"""Source structs to target structs: elevation, choice folding, coercion and subtree hashes as Catalyst expressions.

Each node is built once and hashed once: a projection builds it from its source, the next one hashes what
was built. So expressions grow with the model and not with its depth, and Spark compiles them. Only nodes
in lists are built and hashed by lambdas, which Spark interprets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.errors import ConfigError
from xylem.functions.text import coerce, digest, hash_list, hash_text, strip_blank, tried
from xylem.plans.model import Model, Relation, Table, TargetColumn
from xylem.sources.reader import source_name

#: Name of the hash within target structs.
HASH = "h__"
DIGESTS = {"sha1": "sha1", "md5": "md5", "sha256": "sha256", "sha512": "sha512", "openssl_sha1": "sha1", "openssl_md5": "md5", "openssl_sha256": "sha256", "openssl_sha512": "sha512"}


#: Column with the number of texts that became null, where nulls were asked for.
LOST = "lost__"


def digest_name(model: Model) -> str:
    """The configured hash by name (a string or one of hashlib's constructors), and its size in bytes behind a colon."""
    asked = model.config.get("record_hash_constructor") or "sha1"
    name = asked if isinstance(asked, str) else getattr(asked, "__name__", "")
    if name not in DIGESTS:
        raise ConfigError(f"record_hash_constructor must be sha1, md5, sha256 or sha512, not {asked!r}")
    size = model.config.get("record_hash_size")
    return f"{DIGESTS[name]}:{size}" if size else DIGESTS[name]


def _down(source: Column, path) -> Column:
    for f in path:
        source = source[f.name]
    return source


def text_of(base: Column, leaf) -> Column:
    """The text, or array of texts, of a source field; of mixed content the piece before the first child."""
    value = base[source_name(leaf)]
    return F.get(value, F.lit(0)) if leaf.content else value


def column_value(column: TargetColumn, source: Column, strict: bool = True) -> Column:
    """Typed value, or array of texts, of a target column from its table's source struct."""
    base = _down(source, column.path)
    if column.leaf is None:
        present = [(b, strip_blank(base[source_name(b)])) for b in column.branches]
        if column.name == "type" or column.name.endswith("_type"):
            return F.coalesce(*[F.when(v.isNotNull(), F.lit(b.name)) for b, v in present])
        return coerce(F.coalesce(*[v for _, v in present]), column.value_type, strict)
    value = text_of(base, column.leaf)
    if column.many:
        values = value if column.leaf.many else F.array_compact(F.array(value))
        typed = lambda v: coerce(strip_blank(v), column.value_type, strict).cast("string")
        return F.array_compact(F.transform(values, typed))
    return coerce(strip_blank(value), column.value_type, strict)


def lost_values(table: Table, source: Column) -> Column:
    """How many texts below a source struct aren't of their type and became null."""
    lost = lambda text, kind: (text.isNotNull() & tried(text, kind).isNull()).cast("long")
    total = F.lit(0).cast("long")
    for f in table.fields:
        if isinstance(f, Relation):
            child = _down(source, f.path)[f.leaf.name]
            child = child if f.leaf.many else F.array_compact(F.array(child))
            total = total + F.coalesce(F.aggregate(child, F.lit(0).cast("long"), _adding(f.child)), F.lit(0))
        elif f.leaf is None or isinstance(f.value_type, (T.StringType, T.BooleanType)):
            texts = [strip_blank(_down(source, f.path)[source_name(b)]) for b in f.branches] if f.leaf is None and not f.name.endswith("type") else []
            total = total + sum((F.coalesce(lost(t, f.value_type), F.lit(0)) for t in texts), F.lit(0)) if not isinstance(f.value_type, (T.StringType, T.BooleanType)) else total
        else:
            text = text_of(_down(source, f.path), f.leaf)
            values = text if f.leaf.many else F.array(text)
            total = total + F.coalesce(F.size(F.filter(values, _lost(f.value_type))).cast("long"), F.lit(0))
    return total


def _adding(table: Table):
    return lambda total, x: total + F.when(x.isNull(), F.lit(0).cast("long")).otherwise(lost_values(table, x))


def _lost(kind: T.DataType):
    return lambda v: strip_blank(v).isNotNull() & tried(strip_blank(v), kind).isNull()


def node_hash(table: Table, node: Column, how: str, listed: bool = False) -> Column:
    """Over the fields in model order; a list of children counts whatever their order. listed: within a lambda, where each text is made once only if it is bound."""
    parts, texts = [], []

    def flush() -> None:
        if texts:
            parts.append(F.array_join(F.transform(F.array(*texts), hash_text), ""))
            texts.clear()

    for f in table.fields:
        value = node[f.name]
        if not isinstance(f, Relation) and not f.many:
            if listed:
                texts.append(value.cast("string"))
            else:
                parts.append(hash_text(value))
            continue
        flush()
        if isinstance(f, Relation):
            if f.many:
                each = F.array_sort(F.transform(F.coalesce(value, F.array()), lambda c: c[HASH]))
                parts.append(F.concat(F.lit("("), F.array_join(each, ""), F.lit(")")))
            else:
                parts.append(F.coalesce(value[HASH], F.lit("N")))
        else:
            parts.append(hash_list(value))
    flush()
    return digest(F.concat(*parts) if parts else F.lit(""), how)


def _built(table: Table, source: Column, how: str, strict: bool, made: dict[str, str] | None = None) -> list[Column]:
    """made: columns that hold single children already."""
    fields = []
    for f in table.fields:
        if not isinstance(f, Relation):
            fields.append(column_value(f, source, strict).alias(f.name))
            continue
        child = _down(source, f.path)[f.leaf.name]
        if f.many:
            rows = child if f.leaf.many else F.array_compact(F.array(child))
            fields.append(nodes(f.child, rows, how, strict).alias(f.name))
        else:
            fields.append((F.col(made[f.name]) if made is not None else node(f.child, child, how, strict)).alias(f.name))
    return fields or [F.lit(None).cast("string").alias("empty__")]


def nodes(table: Table, sources: Column, how: str, strict: bool = True) -> Column:
    """Array of target structs from an array of source structs."""
    built = F.transform(F.filter(sources, lambda x: x.isNotNull()), lambda x: F.struct(*_built(table, x, how, strict)))
    names = [f.name for f in table.fields] or ["empty__"]
    return F.transform(built, lambda y: F.struct(*[y[n].alias(n) for n in names], node_hash(table, y, how, True).alias(HASH)))


def node(table: Table, source: Column, how: str, strict: bool = True) -> Column:
    """Target struct with its hash; null where the source is absent."""
    return F.get(nodes(table, F.array(source), how, strict), F.lit(0))


@dataclass
class Single:
    """A node that isn't in a list: its column, and those of its single children by field."""

    name: str
    table: Table
    source: Column
    depth: int
    made: dict[str, str]


def _singles(table: Table, source: Column, name: str, depth: int = 0) -> list[Single]:
    out = [Single(name, table, source, depth, {})]
    for k, f in enumerate(table.fields):
        if isinstance(f, Relation) and not f.many:
            out[0].made[f.name] = f"{name}{k}__"
            out += _singles(f.child, _down(source, f.path)[f.leaf.name], f"{name}{k}__", depth + 1)
    return out


def shaped(model: Model, docs: DataFrame, source: str = "src", out: str = "doc") -> DataFrame:
    """Replace the source struct by the target struct.

    A projection that isn't deterministic stops filters: what reads the target struct, and what drops
    rows without one, read the same evaluation, so a text is parsed and shaped once.
    """
    rest, how = [c for c in docs.columns if c != source], digest_name(model)
    if not model.strict_values:
        docs, rest = docs.withColumn(LOST, lost_values(model.root, F.col(source))), [*rest, LOST]
    singles, done = _singles(model.root, F.col(source), "node__"), []
    for depth in range(max(s.depth for s in singles), -1, -1):
        level = [s for s in singles if s.depth == depth]
        kept = [*rest, *([source] if depth else []), *[s.name for s in done if s.depth > depth + 1]]
        once = lambda s: F.struct(*_built(s.table, s.source, how, model.strict_values, s.made), s.source.isNotNull().alias("there__"), F.rand().alias("once__"))
        docs = docs.select(*kept, *[once(s).alias(s.name) for s in level])
        docs = docs.select(*kept, *[s.name for s in level], *[node_hash(s.table, F.col(s.name), how).alias(f"{s.name}{HASH}") for s in level])
        names = lambda s: [f.name for f in s.table.fields] or ["empty__"]
        whole = lambda s: F.struct(*[F.col(s.name)[n].alias(n) for n in names(s)], F.col(f"{s.name}{HASH}").alias(HASH))
        docs = docs.select(*kept, *[F.when(F.col(s.name)["there__"], whole(s)).alias(s.name) for s in level])
    return docs.select(*[c for c in rest if c != LOST], F.col("node__").alias(out), *[c for c in rest if c == LOST])


def _stripping(table: Table):
    return lambda x: without_hashes(table, x)


def without_hashes(table: Table, value: Column) -> Column:
    """A target struct without the hashes of itself and what is below it, for comparisons."""
    fields = []
    for f in table.fields:
        own = value[f.name]
        if isinstance(f, Relation):
            child = f.child
            own = F.transform(own, _stripping(child)) if f.many else without_hashes(child, own)
        fields.append(own.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*(fields or [F.lit(None).cast("string").alias("empty__")])))
