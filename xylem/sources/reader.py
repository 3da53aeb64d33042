"""XML documents to nested rows, driven by a model.

The read schema holds only the fields the target needs, all as text, so a value that isn't what the
schema says never spoils its document and skipped subtrees are dropped by the parser.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.errors import ConfigError
from xylem.plans.model import Model, Relation, Table
from xylem.sources.xsd import ComplexType, Field

ATTRIBUTE, TEXT, CORRUPT = "attr__", "text__", "corrupt__"
#: Characters that XML 1.0 doesn't allow.
ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\ufffe\uffff]"


def source_name(field: Field) -> str:
    """Name of a source field in the read schema."""
    return ATTRIBUTE + field.name if field.attribute else TEXT if field.content else field.name


def read_schema(table: Table) -> T.StructType:
    """Schema of a table's source struct, elevated children nested as in the documents."""
    tree: dict[str, object] = {}

    def place(path: tuple[Field, ...], leaf: Field, kind: T.DataType) -> None:
        at = tree
        for f in path:
            at = at.setdefault(f.name, {})
        at[source_name(leaf)] = T.ArrayType(kind) if leaf.many or leaf.content else kind  # text: its pieces

    for f in table.fields:
        if isinstance(f, Relation):
            place(f.path, f.leaf, read_schema(f.child))
        else:
            for leaf in (f.leaf,) if f.leaf is not None else f.branches:
                place(f.path, leaf, T.StringType())

    def built(part: dict) -> T.StructType:
        fields = [T.StructField(k, built(v) if isinstance(v, dict) else v) for k, v in part.items()]
        return T.StructType(fields or [T.StructField(TEXT, T.StringType())])

    return built(tree)


def shared_schema(spark: SparkSession, xsd: str, files: list[str]) -> str:
    """A path of the schema that every executor can open: on a cluster a copy, with all it imports, in the shared folder."""
    if spark.sparkContext.master.startswith("local"):
        return xsd
    base = os.path.dirname(os.path.abspath(xsd))
    if any(not os.path.abspath(f).startswith(base + os.sep) for f in files):
        raise ConfigError("to validate on a cluster, a schema's imports must lie beside it or below")
    folder = f"{shared_root(spark)}/xylem-schema-{uuid.uuid4().hex[:12]}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files:
        at = f"{folder}/{os.path.relpath(os.path.abspath(f), base)}"
        fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(f)}"), spark._jvm.org.apache.hadoop.fs.Path(at))
    return f"{folder}/{os.path.basename(xsd)}"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one on one machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_.get() if set_.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.gettempdir()
    return root.rstrip("/")


def _options(xsd: str | None, mode: str) -> dict[str, str]:
    out = {"attributePrefix": ATTRIBUTE, "valueTag": TEXT, "ignoreNamespace": "true", "nullValue": "", "mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    return out | ({"rowValidationXSDPath": xsd} if xsd else {})


def has_mixed(model: Model) -> bool:
    return any(t.mixed and any(not f.attribute and not f.content for f in t.fields) for t in model.types)


def without_tails(xml: Column) -> Column:
    """The text without what stands behind the end of an element: of mixed content only the first piece counts."""
    kept = r"(<!\[CDATA\[[\s\S]*?\]\]>|<!--[\s\S]*?-->|<\?[\s\S]*?\?>)|((?:</[^<>]*|<[^<>!?/][^<>]*/)>)[^<]+(?=<)"
    return F.regexp_replace(xml, F.lit(kept), F.lit("$1$2"))


def root_tag(xml: Column) -> Column:
    """Local name of a document's root element."""
    return F.regexp_extract(xml, r"(?s)^\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)*<(?:[^\s:/>]+:)?([^\s/>]+)", 1)


def repair(text: str) -> str:
    """A well-formed document from a malformed one: bare & and < escaped, unknown ends dropped, open elements closed."""
    out, stack, opened = [], [], False
    for part in re.split(r"(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>|</?[A-Za-z_][^<>]*>)", text, flags=re.S):
        if re.match(r"<!--|<!\[CDATA|<\?|<!DOCTYPE", part):
            out.append(part)
        elif opened and not stack:
            continue  # behind the root
        elif end := re.fullmatch(r"</\s*([^\s>]+)\s*>", part):
            if end[1] in stack:
                while stack[-1] != end[1]:
                    out.append(f"</{stack.pop()}>")
                out.append(f"</{stack.pop()}>")
        elif start := re.fullmatch(r"<([A-Za-z_][^\s/>]*)((?:\s+[^\s=<>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)(.*?)(/?)>", part, re.S):
            out.append(f"<{start[1]}{re.sub(r'&(?!#?\w+;)', '&amp;', start[2])}{start[4]}>")
            opened = True
            if not start[4]:
                stack.append(start[1])
        else:
            out.append(re.sub(r"&(?!#?\w+;)", "&amp;", part).replace("<", "&lt;"))
    return "".join(out) + "".join(f"</{t}>" for t in reversed(stack))


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair(t) if isinstance(t, str) else None)


def _parsed(xml: Column, schema: T.StructType, xsd: str | None) -> Column:
    return F.from_xml(xml, T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), _options(xsd, "PERMISSIVE"))


def parse_column(model: Model, docs: DataFrame, xml: str = "xml", xsd: str | None = None, strict: bool = True, recover: bool = False, out: str = "src") -> DataFrame:
    """Add the source struct of each document's text as `out`.

    xsd: validate against this schema file. strict: a malformed or invalid document fails the query;
    otherwise its struct is null. recover: malformed texts are repaired before they are parsed again.
    """
    kept = docs.columns
    mixed = has_mixed(model)
    xsd = shared_schema(docs.sparkSession, xsd, model.files) if xsd else None
    types = [(f.name, f.type) for f in model.root_type.fields] if model.root_type.virtual else [(model.root_type.table, model.root_type)]

    def trial(df: DataFrame, text: str, name: str) -> DataFrame:
        if not mixed:
            return parsed(df, text, name, xsd)
        df = parsed(df.withColumn("cut__", without_tails(F.col(text))), "cut__", name, None)
        if xsd:  # texts are valid or not as they are
            told = _parsed(F.col(text), T.StructType([]), xsd)[CORRUPT]
            df = df.withColumn(name, F.when(told.isNull(), F.col(name)))
        return df

    def parsed(df: DataFrame, text: str, name: str, xsd: str | None) -> DataFrame:
        if not model.root_type.virtual:
            return df.withColumn(name, _parsed(F.col(text), read_schema(model.root), xsd))
        whole, parts, tag = read_schema(model.root), [], root_tag(F.col(text))
        for f in whole:
            if isinstance(f.dataType, T.StructType):
                one = _parsed(F.col(text), f.dataType, xsd)
                parts.append(F.when(tag == f.name, one).alias(f.name))
            else:
                one = F.xpath_string(F.col(text), F.lit("string(/*)"))
                parts.append(F.when(tag == f.name, one).alias(f.name))
        return df.withColumn(name, F.struct(*parts))

    def corrupt(name: str, text: str) -> Column:
        behind = F.btrim(F.substring_index(F.col(text), ">", -1), F.lit(" \t\r\n")) != ""
        return behind | broken(name)

    def broken(name: str) -> Column:
        if not model.root_type.virtual:
            return F.coalesce(F.col(name)[CORRUPT].isNotNull(), F.lit(True))
        bad = [F.col(name)[f.name][CORRUPT].isNotNull() for f in read_schema(model.root) if isinstance(f.dataType, T.StructType)]
        known = root_tag(F.col(xml)).isin([n for n, _ in types])
        return F.coalesce(F.greatest(*[F.coalesce(b, F.lit(False)) for b in bad], ~known), F.lit(True)) if bad else ~known

    df = trial(docs, xml, out)
    if recover:
        df = df.withColumn("fixed__", _repaired(F.when(corrupt(out, xml), F.col(xml))))
        df = trial(df, "fixed__", "again__")
        df = df.withColumn(out, F.when(F.col("fixed__").isNotNull(), F.col("again__")).otherwise(F.col(out)))
        df = df.withColumn("last__", F.coalesce("fixed__", xml))
    bad = corrupt(out, "last__" if recover else xml)
    failed = F.raise_error(F.concat(F.lit("malformed or invalid document: "), F.substring(F.col(xml), 1, 200))) if strict else F.lit(None)
    df = df.withColumn(out, F.when(F.col(xml).isNull(), F.lit(None)).when(bad, failed).otherwise(F.col(out)))
    return df.select(*kept, out)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and xml of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def read_rows(spark: SparkSession, model: Model, paths: str | list[str], xsd: str | None = None, strict: bool = True) -> DataFrame:
    """Source structs straight from the XML data source, split by root element: for files too large for one row of text."""
    schema = read_schema(model.root)
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.format("xml").schema(schema).options(**_options(xsd, mode)).option("rowTag", model.root_type.table).load(paths)
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("src"))


def names_clash(types: list[ComplexType]) -> bool:
    """True if two fields of one type differ by case only; the session must then be case-sensitive."""
    return any(len({source_name(f).lower() for f in t.fields}) < len({source_name(f) for f in t.fields}) for t in types)
