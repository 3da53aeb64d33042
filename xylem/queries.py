"""Queries over the sample tables: each builds XML documents from whole tables and runs operators on them."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions.names import short_name_column
from xylem.functions.text import split_values
from xylem.operators import extract, merge
from xylem.operators.flatten import KEY, PARENT, ROW, Staged, distinct_documents, flattened, stage
from xylem.operators.shape import HASH, LOST, shaped
from xylem.plans.model import Model
from xylem.sources import reader, xmlout
from xylem.sources.store import ParquetStore

SAMPLES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "samples")
ITEM = ("flag", "status", "quantity", "discount")
#: Fields of an order that the hash query leaves out.
REST = ("priority", "placed", "total", "paid", "customer", "payment", "rush", "note", "tag", "internal")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder; a local one only where none is set."""
    return f"{reader.shared_root(spark)}/xylem-store-{uuid.uuid4().hex[:12]}"


@functools.cache
def _model(name: str, key: str) -> Model:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Model(f"{SAMPLES}/{name}.xsd", name, CONFIGS[key])


CONFIGS: dict[str, dict] = {
    "plain": {},
    "owned": {"row_numbers": True, "tables": {"item": {"reuse": False}}},
    "rows": {"row_numbers": True},
    "nation": {"tables": {"customer": {"fields": {"nation": {"transform": False}}}}},
    "skip": {"tables": {"order": {"fields": {"internal": {"transform": "skip"}}}}},
    "meta": {"metadata_columns": [{"name": "origin", "type": "String(20)"}]},
    "rename": {"tables": {"order": {"fields": {"total": {"rename": "amount", "type": "Numeric(18, 2)"}}}}},
    "keys": {"tables": {"order": {"fields": {f: {"transform": "skip"} for f in REST}}}},
    "nulls": {"bad_values": "null"},
    "short": {"record_hash_constructor": "md5", "record_hash_size": 8},
    "sha512": {"record_hash_constructor": "sha512"},
    "join": {"tables": {"order": {"fields": {"tag": {"transform": "join"}}}}},
    "itemless": {"tables": {"order": {"fields": {"item": {"transform": "skip"}}}}},
    "flat": {"transform": False},
}


def _xml(fields: Column, tag: str) -> Column:
    return F.to_xml(fields, {"rowTag": tag, "attributePrefix": reader.ATTRIBUTE, "valueTag": reader.TEXT, "declaration": ""})


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and xml: one document an order, its lines as items."""
    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    item = lambda x: F.struct(x["l_returnflag"].alias("attr__flag"), x["l_linestatus"].alias("attr__status"), x["l_quantity"].alias("quantity"), x["l_discount"].alias("discount"))
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = _table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    # texts are much larger than the rows they are made of, so the rows are dealt to all tasks
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").join(lines, "o_orderkey", "left")
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    paid = lambda k: F.when(kind == k, F.col("o_orderpriority"))
    fields = F.struct(
        key.alias("attr__key"),
        F.col("o_orderpriority").alias("attr__priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("placed"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("0").alias("paid"),
        F.struct(
            F.col("c_custkey").alias("attr__key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"),
            F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"),
        ).alias("customer"),
        F.struct(paid(0).alias("cash"), paid(1).alias("card"), paid(2).alias("transfer")).alias("payment"),
        F.when(key % 4 == 0, F.struct(F.col("o_orderpriority").alias("level"))).alias("rush"),
        F.struct(F.lit("en").alias("attr__lang"), F.concat(F.lit("  order "), key.cast("string"), F.lit(" \n")).alias("text__")).alias("note"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit('a,b"'), (key % 10).cast("string"))).alias("tag"),
        F.lit("x").alias("internal"),
        F.transform("lines", item).alias("item"),
    )
    return orders.select(key.alias("key"), _xml(fields, "order").alias("xml"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xml: one document a part, with text before, between and behind its elements."""
    key = F.col("p_partkey")
    finish = F.when(key % 2 == 0, "matt").otherwise("gloss")
    pieces = [
        F.lit('<part brand="'), F.col("p_brand"), F.lit('">  about '), key.cast("string"), F.lit("\n<name>"), F.col("p_name"), F.lit("</name>between<serial>"), (key + 4_000_000_000).cast("string"), F.lit("</serial><size>"),
        F.col("p_size").cast("string"), F.lit("</size>&amp;<codes> a  b </codes><price currency='EUR'>"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("</price><"), finish, F.lit("/>behind</part>"),
    ]
    return _table(spark, sf_dir, "part").select(F.regexp_replace(F.concat(*pieces), "<(matt|gloss)/>", "<$1>x</$1>").alias("xml"))


def party_texts(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """xml: customers and suppliers, one document each. bad: every fifth supplier's balance is no number."""
    customer = F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance")).alias("person"))
    balance = F.when((F.col("s_suppkey") % 5 == 0) & F.lit(bad), "n/a").otherwise(F.col("s_acctbal").cast("decimal(18,2)").cast("string"))
    supplier = F.struct(F.col("s_name").alias("name"), balance.alias("balance"))
    customers = _table(spark, sf_dir, "customer").select(_xml(customer, "customer").alias("xml"))
    return customers.unionByName(_table(spark, sf_dir, "supplier").select(_xml(supplier, "supplier").alias("xml")))


def _staged(texts: DataFrame, model: Model, parse_once: bool = False, **metadata: Column) -> Staged:
    """parse_once: through a nested staging table, as a load does, for queries that read more than one table."""
    docs = shaped(model, reader.parse_column(model, texts).select("src", *[c.alias(n) for n, c in metadata.items()]))
    if parse_once:
        folder = scratch(texts.sparkSession)
        docs = distinct_documents(stage(docs, f"{folder}/all"), f"{folder}/once")
    return flattened(model, docs, metadata=list(metadata), distinct=parse_once)


def _orders(spark: SparkSession, sf_dir: str, key: str = "plain", parse_once: bool = False) -> Staged:
    return _staged(order_texts(spark, sf_dir), _model("orders", key), parse_once)


def _root(staged: Staged, *columns: str) -> DataFrame:
    return staged.records(staged.model.root).select(*columns)


def _items(staged: Staged) -> DataFrame:
    return staged.records(staged.model.table("item"))


def shred_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = F.date_format("placed", "yyyy-MM-dd HH:mm:ss").alias("placed")
    return _orders(spark, sf_dir).records(_model("orders", "plain").root).select("key", "priority", placed, "total", "paid")


def shred_reused_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_orders(spark, sf_dir)).select(*ITEM)


def shred_nn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _orders(spark, sf_dir, parse_once=True)
    return staged.links["order_item"].join(_items(staged), KEY).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_links"))


def shred_duplicated_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _orders(spark, sf_dir, "owned", True)
    keys = staged.records(staged.model.root).select(F.col(KEY).alias(PARENT), F.col("key").alias("order_key"))
    return _items(staged).join(keys, PARENT).select("order_key", *ITEM)


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _orders(spark, sf_dir, "owned", True)
    keys = staged.records(staged.model.root).select(F.col(KEY).alias(PARENT), F.col("key").alias("order_key"))
    return _items(staged).join(keys, PARENT).select("order_key", F.col(ROW).cast("int").alias("row_number"), *ITEM)


def elevate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "customer_key", "customer_name", "customer_segment", "customer_balance", "customer_nation_name", "customer_nation_region_name")


def elevate_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "rush_level")


def elevate_wo_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _root(_staged(party_texts(spark, sf_dir), _model("parties", "plain")), "customer_name", "customer_balance")
    return rows.where("customer_name IS NOT NULL")


def virtual_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(party_texts(spark, sf_dir), _model("parties", "plain")).records(_model("parties", "plain").root)
    kind = F.when(F.col("customer_name").isNotNull(), "customer").otherwise("supplier")
    return rows.select(kind.alias("kind"), F.coalesce("customer_name", "supplier_name").alias("name"))


def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't numbers become null, where that is asked for."""
    rows = _root(_staged(party_texts(spark, sf_dir, True), _model("parties", "nulls")), "supplier_name", "supplier_balance")
    return rows.where("supplier_name IS NOT NULL")


def lost_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts a load that may lose values has lost."""
    docs = shaped(_model("parties", "nulls"), reader.parse_column(_model("parties", "nulls"), party_texts(spark, sf_dir, True)).select("src"))
    return docs.agg(F.sum(LOST).alias("lost"))


def large_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_staged(part_texts(spark, sf_dir), _model("parts", "plain")), "brand", "serial")


def mixed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of mixed content the text before the first element."""
    return _root(_staged(part_texts(spark, sf_dir), _model("parts", "plain")), "serial", "value")


def imported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema with imports, includes, groups, derived, union and list types."""
    return _root(_staged(part_texts(spark, sf_dir), _model("parts", "plain")), "serial", "name", "size", "codes", "price_currency", "price_value", "matt", "gloss")


def namespaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    swaps = (("</", "\1"), ("<", "<o:"), ("\1", "</o:"), ("<o:order ", "<o:order xmlns:o='urn:orders' "))  # every < of these texts begins a tag
    xml = functools.reduce(lambda x, swap: F.replace(x, *map(F.lit, swap)), swaps, F.col("xml"))
    return _root(_staged(order_texts(spark, sf_dir).select(xml.alias("xml")), _model("orders", "plain")), "key", "customer_name", "total")


def rel1_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _orders(spark, sf_dir, "nation", True)
    nations = staged.records(staged.model.table("nation")).select(F.col(KEY).alias("fk"), "name", "region_name")
    return staged.records(staged.model.root).join(nations, F.col("fk_customer_nation") == F.col("fk")).select("key", F.col("name").alias("nation"), F.col("region_name").alias("region"))


def choice_type_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "payment_type", "payment_value")


def join_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "tag")


def split_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "tag").select("key", F.posexplode(split_values(F.col("tag"))).alias("place", "value"))


def skip_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of an order without the skipped one."""
    rows = _orders(spark, sf_dir, "skip").records(_model("orders", "skip").root).drop(KEY)
    return rows.withColumn("placed", F.date_format("placed", "yyyy-MM-dd HH:mm:ss"))


def join_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir, "join"), "key", "tag")


def pruned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are left when nothing points to one, or nothing is simplified; each parent, and whether it stands behind the table."""
    rows = []
    for key in ("plain", "itemless", "flat"):
        names = [t.name for t in _model("orders", key).tables]
        for t in _model("orders", key).tables:
            rows += [(key, t.name, p.name, names.index(t.name) < names.index(p.name)) for p, _ in t.parents] or [(key, t.name, None, None)]
    return spark.createDataFrame(rows, "config string, table_name string, parent string, before_parent boolean")


def unsimplified_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table when no child is elevated and no choice folded."""
    staged = _orders(spark, sf_dir, "flat", True)
    parts = [staged.keys(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows") for t in staged.model.tables]
    return functools.reduce(DataFrame.unionByName, parts)


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the trees, the diagram and the statements of the parties' model."""
    model = _model("parties", "plain")
    texts = {"source": model.source_tree, "target": model.target_tree, "erd": model.erd(), "ddl": ";\n".join(model.create_statements())}
    return spark.createDataFrame([(k, i, line) for k, t in texts.items() for i, line in enumerate(t.split("\n"))], "what string, place int, line string")


def mixed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(_orders(spark, sf_dir), "key", "note_lang", "note_value")


def metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model("orders", "meta")
    return _staged(order_texts(spark, sf_dir), model, origin=F.lit("tables")).records(model.root).select("key", "origin")


def rename_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "rename").records(_model("orders", "rename").root).select("key", F.col("amount").cast("string").alias("amount"))


def record_hash_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_orders(spark, sf_dir)).select(*ITEM, F.col(KEY).alias("hash"))


def bulk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a database's bulk loader reads them: escapes, truth values, bytes and nulls."""
    from xylem.plans import dialects

    hashed = F.when(F.col("s_suppkey") % 3 != 0, F.unhex(F.md5(F.col("s_name").cast("binary"))))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit("\t")).alias("name"), (F.col("s_suppkey") % 2 == 0).alias("even"), hashed.alias("hash"))
    return dialects.lines(rows, dialects.dialect("postgresql")).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("s_suppkey"), F.col("value").alias("line"))


def database_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' tables copied to a database by JDBC after each of two loads, read back from it."""
    from xylem.sources import databases

    folder, properties = tempfile.mkdtemp(prefix="xylem-derby-"), {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = f"jdbc:derby:{folder}/copy"
    try:
        store, model, _ = _loaded(spark, sf_dir, "rows", lambda store, model: databases.to_jdbc(store, model, f"{url};create=true", "derby", properties))
        back = {n: databases.brought(spark, url, f'"{n}"', f"{store.root}/_back/{n}", properties) for n in model.schemas()}
    finally:
        databases.closed(spark, url)
        shutil.rmtree(folder)
    rows = back["order_item"].join(back["order"], F.col("fk_order") == F.col("pk_order")).join(back["item"], F.col("fk_item") == F.col("pk_item"))
    return rows.select(F.col("key").alias("order_key"), "row_number", *ITEM)


def record_hash_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another hash, cut to a size in bytes."""
    return _items(_orders(spark, sf_dir, "short")).select(*ITEM, F.col(KEY).alias("hash"))


def record_hash_sha512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_orders(spark, sf_dir, "sha512")).select(*ITEM, F.col(KEY).alias("hash"))


def record_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "keys").records(_model("orders", "keys").root).select("key", F.col(KEY).alias("hash"))


def _loaded(spark: SparkSession, sf_dir: str, key: str, after: Callable[[ParquetStore, Model], object] = lambda store, model: None) -> tuple[ParquetStore, Model, merge.MergeStats]:
    """A store with the even orders loaded first and then all of them; the statistics of the second load. after: what follows each load."""
    model, store, texts = _model("orders", key), ParquetStore(spark, scratch(spark)), order_texts(spark, sf_dir)
    staged = f"{store.root}/_staging"
    docs = stage(shaped(model, reader.parse_column(model, texts).select("key", "src")), f"{staged}/all")
    docs = distinct_documents(docs, f"{staged}/once")
    merge.merge(flattened(model, docs.where("key % 2 = 0"), distinct=True), store)
    after(store, model)
    stats = merge.merge(flattened(model, docs, distinct=True), store)
    after(store, model)
    return store, model, stats


def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model, stats = _loaded(spark, sf_dir, "rows")
    rows = [(n, stats.inserted[n], stats.existing.get(n, 0)) for n in stats.inserted]
    return spark.createDataFrame(rows, "table_name string, inserted long, existing long")


def merge_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, model, _ = _loaded(spark, sf_dir, "rows")
    tables = {n: store.read(n, s) for n, s in model.schemas().items()}
    rows = tables["order_item"].join(tables["order"], F.col("fk_order") == F.col("pk_order")).join(tables["item"], F.col("fk_item") == F.col("pk_item"))
    return rows.select(F.col("key").alias("order_key"), F.col("row_number"), *ITEM)


def merge_rel1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of only children after two loads."""
    store, model, _ = _loaded(spark, sf_dir, "nation")
    tables = {n: store.read(n, s) for n, s in model.schemas().items()}
    nations = tables["nation"].select("pk_nation", F.col("name").alias("nation"), F.col("region_name").alias("region"))
    return tables["order"].join(nations, F.col("fk_customer_nation") == F.col("pk_nation")).select("key", "nation", "region")


def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary keys are the whole numbers from 1 on, over all loads; compaction leaves them."""
    store, model, _ = _loaded(spark, sf_dir, "owned")
    store.compact(model.schemas())
    key = lambda n, s: store.read(n, s).agg(F.count(F.lit(1)).alias("n_rows"), F.min(s.names[0]).alias("least"), F.max(s.names[0]).alias("most"), F.count_distinct(s.names[0]).alias("different"))
    parts = [key(n, s).select(F.lit(n).alias("table_name"), "*") for n, s in model.schemas().items()]
    return functools.reduce(DataFrame.unionByName, parts)


def _loaded_by_api(spark: SparkSession, sf_dir: str, config: dict):
    from xylem.api import DataModel

    model = DataModel(f"{SAMPLES}/orders.xsd", "orders", model_config=config, connection_string=scratch(spark), db_engine=spark)
    model.parse_xml(order_texts(spark, sf_dir)).insert_into_target_tables()
    return model


def document_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook that keeps urgent orders only."""
    model = _loaded_by_api(spark, sf_dir, {"document_tree_hook": lambda docs: docs.where("doc.priority = '1-URGENT'")})
    return model.store.read("order", model.plan.schemas()["order"]).select("key", "priority")


def node_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook on the records of a table."""
    lower = lambda name, rows: rows.withColumn("flag", F.lower("flag")) if name == "item" else rows
    model = _loaded_by_api(spark, sf_dir, {"document_tree_node_hook": lower})
    return model.store.read("item", model.plan.schemas()["item"]).select(*ITEM)


def yaml_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration written in YAML."""
    from xylem.plans.config import parse_config

    config = parse_config("row_numbers: line\ntables:\n  order:\n    fields:\n      total: {rename: amount, type: 'Numeric(18, 2)'}\n  item:\n    reuse: false\n")
    model = _loaded_by_api(spark, sf_dir, config)
    tables = {n: model.store.read(n, s) for n, s in model.plan.schemas().items()}
    rows = tables["item"].join(tables["order"], F.col("fk_parent_order") == F.col("pk_order"))
    return rows.groupBy("key", F.col("amount").cast("string").alias("amount")).agg(F.max("line").alias("lines"))


def dropped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after all tables are dropped."""
    model = _loaded_by_api(spark, sf_dir, {})
    schema = model.plan.schemas()["order"]
    before = model.store.read("order", schema).count()
    model.drop_all_tables()
    return spark.createDataFrame([(before, model.store.read("order", schema).count())], "before long, after long")


def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, model, _ = _loaded(spark, sf_dir, "rows")
    return extract.Extract(model, store, "priority = '2-HIGH'", "Etc/GMT-2").documents().select(F.col("n__.key").alias("order_key"), F.col("n__.placed").alias("placed"))


def merge_child_of_new_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, model, _ = _loaded(spark, sf_dir, "owned")
    tables = {n: store.read(n, s) for n, s in model.schemas().items()}
    rows = tables["item"].join(tables["order"], F.col("fk_parent_order") == F.col("pk_order"))
    return rows.groupBy(F.col("key").alias("order_key")).agg(F.count(F.lit(1)).alias("n_items"))


def extract_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, model, _ = _loaded(spark, sf_dir, "rows")
    nodes = extract.Extract(model, store, "priority = '1-URGENT'").documents()
    return nodes.select(F.col("n__.key").alias("order_key"), F.coalesce(F.size("n__.item"), F.lit(0)).alias("n_items"))


def unflatten_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, model, _ = _loaded(spark, sf_dir, "owned")
    item = lambda x: F.concat_ws("-", x["flag"], x["status"], x["quantity"].cast("int").cast("string"))
    nodes = extract.Extract(model, store).documents()
    return nodes.select(F.col("n__.key").alias("order_key"), F.array_join(F.transform("n__.item", item), "|").alias("items")).where("items <> ''")


def roundtrip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, extract, write as XML, parse and flatten again."""
    store, model, _ = _loaded(spark, sf_dir, "rows")
    texts = extract.Extract(model, store).documents().select(xmlout.to_xml(model).alias("xml"))
    docs = shaped(model, reader.parse_column(model, texts))
    placed = F.date_format("doc.placed", "yyyy-MM-dd HH:mm:ss").alias("placed")
    return docs.select(F.col("doc.key").alias("order_key"), placed, F.col("doc.total").alias("total"), F.col("doc.payment_type").alias("payment_type"), F.array_join("doc.tag", "|").alias("tags"), F.coalesce(F.size("doc.item"), F.lit(0)).alias("n_items"))


def identifier_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("parts_that_have_a_rather_long_prefix_before_"), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", short_name_column(name).alias("identifier"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document lacks the end of its root and has a bare ampersand."""
    bad = F.regexp_replace(F.regexp_replace("xml", "</order>", ""), "<internal>x", "<internal>x & y")
    return order_texts(spark, sf_dir).select("key", F.when(F.col("key") % 7 == 0, bad).otherwise(F.col("xml")).alias("xml"))


def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.parse_column(_model("orders", "plain"), _broken(spark, sf_dir), strict=False).where("src IS NULL").select("key")


def recovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model("orders", "plain")
    docs = shaped(model, reader.parse_column(model, _broken(spark, sf_dir), recover=True))
    return docs.select("key", F.col("doc.key").alias("parsed_key"), F.col("doc.internal").alias("internal"), F.coalesce(F.size("doc.item"), F.lit(0)).alias("n_items"))


def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that break the schema: every ninth has no total."""
    texts = order_texts(spark, sf_dir).select("key", F.when(F.col("key") % 9 == 0, F.regexp_replace("xml", "<total>[^<]*</total>", "")).otherwise(F.col("xml")).alias("xml"))
    parsed = reader.parse_column(_model("orders", "plain"), texts, xsd=f"{SAMPLES}/orders.xsd", strict=False)
    return parsed.select("key", F.col("src").isNotNull().alias("valid"))


def flatten_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table and link table."""
    staged = _orders(spark, sf_dir, "nation", True)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in ({t.name: staged.keys(t) for t in staged.model.tables} | staged.links).items()]
    return functools.reduce(DataFrame.unionByName, parts)


def unflatten_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each staged order put together again from the flat tables."""
    staged = _orders(spark, sf_dir, parse_once=True)
    joined = staged.links["order_item"].join(_items(staged).select(KEY, F.col("quantity").alias("q")), KEY)
    sums = joined.groupBy(PARENT).agg(F.array_sort(F.collect_list("q")).alias("q"))
    roots = staged.records(staged.model.root).select(F.col(KEY).alias(PARENT), "key")
    return roots.join(sums, PARENT).select("key", F.array_join(F.transform("q", lambda x: x.cast("int").cast("string")), ",").alias("quantities"))


def equal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ by blanks, unknown elements and the order of items have the same hash."""
    model, texts = _model("orders", "skip"), order_texts(spark, sf_dir)
    noisy = functools.reduce(lambda x, swap: F.replace(x, *map(F.lit, swap)), (("<internal>x</internal>", "<internal>other</internal><unknown><a/></unknown>"), ("<total>", "<total>  ")), F.col("xml"))
    hashed = lambda df, c, n: shaped(model, reader.parse_column(model, df.withColumn("xml", F.col(c)).drop(c))).withColumn(n, F.col("doc")[HASH]).drop("doc")
    both = hashed(hashed(texts.select("key", F.col("xml").alias("plain"), noisy.alias("noisy")), "plain", "a"), "noisy", "b")
    return both.select("key", (F.col("a") == F.col("b")).alias("equal"))


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier documents arrive as files and are merged by a stream."""
    from xylem.api import DataModel
    from xylem.streaming.load import load_stream

    folder = scratch(spark)
    suppliers = _table(spark, sf_dir, "supplier").select(_xml(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("balance")), "supplier").alias("value"))
    lines = suppliers.select(F.regexp_replace("value", r"\s*\n\s*", "").alias("value"))
    lines.write.text(f"{folder}/in")
    model = DataModel(f"{SAMPLES}/parties.xsd", "parties", connection_string=f"{folder}/store", db_engine=spark)
    texts = spark.readStream.format("text").load(f"{folder}/in").select(F.col("value").alias("xml"))
    load_stream(model, texts, f"{folder}/checkpoint").awaitTermination()
    return model.store.read("parties", model.plan.schemas()["parties"]).select("supplier_name", "supplier_balance")


QUERIES = {f.__name__: f for f in (
    shred_root, shred_reused_items, shred_nn_links, shred_duplicated_child, row_numbers, elevate_prefix, elevate_optional, elevate_wo_prefix, virtual_root, coerce_types,
    rel1_fk, choice_type_value, join_values, split_joined, skip_field, mixed_value, metadata_columns, rename_retype, record_hash_leaf, record_hash_tree, merge_stats, merge_new_rows,
    merge_child_of_new_parent, extract_where, unflatten_grouped, roundtrip_rows, identifier_shorten, invalid_rows, recovered_rows, validated_rows, flatten_counts, unflatten_nodes,
    equal_documents, stream_load, lost_values, large_integers, mixed_pieces, imported_types, namespaced_documents, join_asked, pruned_tables, unsimplified_tables, model_texts,
    record_hash_short, record_hash_sha512, merge_rel1, merge_keys, document_hook, node_hook, yaml_config, dropped_tables, zoned_times, bulk_lines, database_copy,
)}

_O = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_L = f"(SELECT lineitem.* FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {_O}))"
_ITEM = "l_returnflag AS flag, l_linestatus AS status, l_quantity AS quantity, l_discount AS discount"
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount)::INT"
_TAG = "'\"a,b\\\"' || (o_orderkey % 10) || '\"'"
_LEN = "(length({0}) || ':' || {0})"
_HASH = "sha1(" + " || ".join(_LEN.format(f"({c})::VARCHAR") for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount")) + ")"
_ONE = f"SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM {_L}"

ORACLE_SQL = {
    "shred_root": f"SELECT DISTINCT o_orderkey AS key, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_totalprice::DECIMAL(18,2)::DOUBLE AS total, o_orderstatus = 'F' AS paid FROM {_O}",
    "shred_reused_items": f"SELECT DISTINCT {_ITEM} FROM {_L}",
    "shred_nn_links": f"SELECT {_ITEM}, count(*) AS n_links FROM {_L} GROUP BY ALL",
    "shred_duplicated_child": f"SELECT l_orderkey AS order_key, {_ITEM} FROM {_L}",
    "row_numbers": f"SELECT l_orderkey AS order_key, {_PLACE} AS row_number, {_ITEM} FROM {_L}",
    "elevate_prefix": f"SELECT o_orderkey AS key, c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS customer_segment, c_acctbal::DECIMAL(18,2)::DOUBLE AS customer_balance, n_name AS customer_nation_name, r_name AS customer_nation_region_name FROM {_O}",
    "elevate_optional": f"SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS rush_level FROM {_O}",
    "elevate_wo_prefix": "SELECT DISTINCT c_name AS customer_name, c_acctbal::DECIMAL(18,2)::DOUBLE AS customer_balance FROM customer",
    "virtual_root": "SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier",
    "coerce_types": "SELECT DISTINCT s_name AS supplier_name, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal::DECIMAL(18,2)::DOUBLE END AS supplier_balance FROM supplier",
    "rel1_fk": f"SELECT o_orderkey AS key, n_name AS nation, r_name AS region FROM {_O}",
    "choice_type_value": f"SELECT o_orderkey AS key, ['cash', 'card', 'transfer'][(o_orderkey % 3 + 1)::INT] AS payment_type, o_orderpriority AS payment_value FROM {_O}",
    "join_values": f"SELECT o_orderkey AS key, o_orderpriority || ',' || {_TAG} AS tag FROM {_O}",
    "split_joined": f"SELECT o_orderkey AS key, 0::INT AS place, o_orderpriority AS value FROM {_O} UNION ALL SELECT o_orderkey, 1, 'a,b\"' || (o_orderkey % 10) FROM {_O}",
    "skip_field": f"""SELECT o_orderkey AS key, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_totalprice::DECIMAL(18,2)::DOUBLE AS total, o_orderstatus = 'F' AS paid,
        c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS customer_segment, c_acctbal::DECIMAL(18,2)::DOUBLE AS customer_balance, n_name AS customer_nation_name, r_name AS customer_nation_region_name,
        ['cash', 'card', 'transfer'][(o_orderkey % 3 + 1)::INT] AS payment_type, o_orderpriority AS payment_value, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS rush_level,
        'en' AS note_lang, 'order ' || o_orderkey AS note_value, o_orderpriority || ',' || {_TAG} AS tag FROM {_O}""",
    "join_asked": f"SELECT o_orderkey AS key, o_orderpriority || ',' || {_TAG} AS tag FROM {_O}",
    "lost_values": "SELECT count(*) AS lost FROM supplier WHERE s_suppkey % 5 = 0",
    "large_integers": "SELECT p_brand AS brand, p_partkey + 4000000000 AS serial FROM part",
    "mixed_pieces": "SELECT p_partkey + 4000000000 AS serial, 'about ' || p_partkey AS value FROM part",
    "imported_types": "SELECT p_partkey + 4000000000 AS serial, p_name AS name, p_size AS size, 'a  b' AS codes, 'EUR' AS price_currency, p_retailprice::DECIMAL(18,2)::DOUBLE AS price_value, CASE WHEN p_partkey % 2 = 0 THEN 'x' END AS matt, CASE WHEN p_partkey % 2 <> 0 THEN 'x' END AS gloss FROM part",
    "namespaced_documents": f"SELECT o_orderkey AS key, c_name AS customer_name, o_totalprice::DECIMAL(18,2)::DOUBLE AS total FROM {_O}",
    "pruned_tables": """SELECT config, table_name, parent, CASE WHEN parent IS NOT NULL THEN true END AS before_parent FROM (VALUES ('plain', 'item', 'order'), ('plain', 'order', NULL), ('itemless', 'order', NULL),
        ('flat', 'item', 'order'), ('flat', 'note', 'order'), ('flat', 'payment', 'order'), ('flat', 'rush', 'order'), ('flat', 'customer', 'order'), ('flat', 'nation', 'customer'), ('flat', 'region', 'nation'),
        ('flat', 'order', NULL)) AS t(config, table_name, parent)""",
    "unsimplified_tables": f"""SELECT 'order' AS table_name, count(*) AS n_rows FROM {_O} UNION ALL SELECT 'item', count(*) FROM ({_ONE}) UNION ALL SELECT 'nation', count(DISTINCT n_name) FROM {_O}
        UNION ALL SELECT 'region', count(DISTINCT r_name) FROM {_O} UNION ALL SELECT 'customer', count(DISTINCT c_custkey) FROM {_O} UNION ALL SELECT 'note', count(*) FROM {_O}
        UNION ALL SELECT 'payment', count(DISTINCT (o_orderkey % 3) || o_orderpriority) FROM {_O} UNION ALL SELECT 'rush', count(DISTINCT o_orderpriority) FROM {_O} WHERE o_orderkey % 4 = 0""",
    "model_texts": """SELECT * FROM (VALUES ('source', 0::INT, 'parties:'), ('source', 1, '    customer[1, 1]:'), ('source', 2, '        person[1, 1]:'), ('source', 3, '            name[1, 1]: string'),
        ('source', 4, '            balance[1, 1]: decimal'), ('source', 5, '    supplier[1, 1]:'), ('source', 6, '        name[1, 1]: string'), ('source', 7, '        balance[1, 1]: decimal'),
        ('target', 0, 'parties:'), ('target', 1, '    customer_name[1, 1]: string'), ('target', 2, '    customer_balance[1, 1]: decimal'), ('target', 3, '    supplier_name[1, 1]: string'), ('target', 4, '    supplier_balance[1, 1]: decimal'),
        ('erd', 0, '```mermaid'), ('erd', 1, 'erDiagram'), ('erd', 2, '    parties {'), ('erd', 3, '        string customer_name'), ('erd', 4, '        decimal customer_balance'), ('erd', 5, '        string supplier_name'),
        ('erd', 6, '        decimal supplier_balance'), ('erd', 7, '    }'), ('erd', 8, '```'),
        ('ddl', 0, 'CREATE TABLE IF NOT EXISTS `parties` ('), ('ddl', 1, '  `pk_parties` BIGINT NOT NULL,'), ('ddl', 2, '  `customer_name` VARCHAR(1000),'), ('ddl', 3, '  `customer_balance` DOUBLE,'),
        ('ddl', 4, '  `supplier_name` VARCHAR(1000),'), ('ddl', 5, '  `supplier_balance` DOUBLE,'), ('ddl', 6, '  `record_hash` BINARY'), ('ddl', 7, ') USING parquet')) AS t(what, place, line)""",
    "bulk_lines": "SELECT s_suppkey, s_suppkey || chr(9) || replace(s_name, '#', chr(92) || 't') || chr(9) || CASE WHEN s_suppkey % 2 = 0 THEN 't' ELSE 'f' END || chr(9) || CASE WHEN s_suppkey % 3 = 0 THEN chr(92) || 'N' ELSE chr(92) || chr(92) || 'x' || upper(md5(s_name)) END AS line FROM supplier",
    "record_hash_short": f"SELECT DISTINCT {_ITEM}, left({_HASH.replace('sha1(', 'md5(')}, 16) AS hash FROM {_L}",
    "database_copy": f"SELECT l_orderkey AS order_key, {_PLACE} AS row_number, {_ITEM} FROM {_L}",
    "merge_rel1": f"SELECT o_orderkey AS key, n_name AS nation, r_name AS region FROM {_O}",
    "merge_keys": f"""SELECT 'order' AS table_name, count(*) AS n_rows, 1 AS least, count(*) AS most, count(*) AS different FROM {_O} UNION ALL SELECT 'item', count(*), 1, count(*), count(*) FROM {_L}""",
    "document_hook": f"SELECT o_orderkey AS key, o_orderpriority AS priority FROM {_O} WHERE o_orderpriority = '1-URGENT'",
    "node_hook": f"SELECT DISTINCT lower(l_returnflag) AS flag, l_linestatus AS status, l_quantity AS quantity, l_discount AS discount FROM {_L}",
    "yaml_config": f"SELECT o_orderkey AS key, any_value(o_totalprice::DECIMAL(18,2)::VARCHAR) AS amount, count(*)::INT AS lines FROM {_O} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "dropped_tables": f"SELECT count(*) AS before, 0 AS after FROM {_O}",
    "zoned_times": f"SELECT o_orderkey AS order_key, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000+02:00') AS placed FROM {_O} WHERE o_orderpriority = '2-HIGH'",
    "mixed_value": f"SELECT o_orderkey AS key, 'en' AS note_lang, 'order ' || o_orderkey AS note_value FROM {_O}",
    "metadata_columns": f"SELECT o_orderkey AS key, 'tables' AS origin FROM {_O}",
    "rename_retype": f"SELECT o_orderkey AS key, o_totalprice::DECIMAL(18,2)::VARCHAR AS amount FROM {_O}",
    "record_hash_leaf": f"SELECT DISTINCT {_ITEM}, {_HASH} AS hash FROM {_L}",
    "record_hash_tree": f"SELECT o_orderkey AS key, sha1({_LEN.format('o_orderkey::VARCHAR')} || '(' || coalesce(h, '') || ')') AS hash FROM {_O} LEFT JOIN (SELECT l_orderkey, string_agg(h, '' ORDER BY h) AS h FROM (SELECT l_orderkey, {_HASH} AS h FROM {_L}) GROUP BY 1) ON l_orderkey = o_orderkey",
    "merge_stats": f"""
        WITH a AS ({_ONE}), e AS ({_ONE} WHERE l_orderkey % 2 = 0), o AS (SELECT o_orderkey FROM {_O})
        SELECT 'order' AS table_name, count(*) FILTER (o_orderkey % 2 <> 0) AS inserted, count(*) FILTER (o_orderkey % 2 = 0) AS existing FROM o
        UNION ALL SELECT 'item', (SELECT count(*) FROM a) - (SELECT count(*) FROM e), (SELECT count(*) FROM e)
        UNION ALL SELECT 'order_item', count(*), 0 FROM {_L} WHERE l_orderkey % 2 <> 0""",
    "merge_new_rows": f"SELECT l_orderkey AS order_key, {_PLACE} AS row_number, {_ITEM} FROM {_L}",
    "merge_child_of_new_parent": f"SELECT l_orderkey AS order_key, count(*) AS n_items FROM {_L} GROUP BY 1",
    "extract_where": f"SELECT o_orderkey AS order_key, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n_items FROM {_O} WHERE o_orderpriority = '1-URGENT'",
    "unflatten_grouped": f"SELECT l_orderkey AS order_key, string_agg(l_returnflag || '-' || l_linestatus || '-' || l_quantity::INT, '|' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount) AS items FROM {_L} GROUP BY 1",
    "roundtrip_rows": f"SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_totalprice::DECIMAL(18,2)::DOUBLE AS total, ['cash', 'card', 'transfer'][(o_orderkey % 3 + 1)::INT] AS payment_type, o_orderpriority || '|a,b\"' || (o_orderkey % 10) AS tags, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n_items FROM {_O}",
    "identifier_shorten": "SELECT p_partkey, CASE WHEN length(n) <= 63 THEN n ELSE left(n, 55) || '_' || left(md5(n), 7) END AS identifier FROM (SELECT p_partkey, 'parts_that_have_a_rather_long_prefix_before_' || p_name AS n FROM part)",
    "invalid_rows": f"SELECT o_orderkey AS key FROM {_O} WHERE o_orderkey % 7 = 0",
    "recovered_rows": f"SELECT o_orderkey AS key, o_orderkey AS parsed_key, CASE WHEN o_orderkey % 7 = 0 THEN 'x & y' ELSE 'x' END AS internal, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n_items FROM {_O}",
    "validated_rows": f"SELECT o_orderkey AS key, o_orderkey % 9 <> 0 AS valid FROM {_O}",
    "flatten_counts": f"SELECT 'order' AS table_name, count(*) AS n_rows FROM {_O} UNION ALL SELECT 'item', count(*) FROM ({_ONE}) UNION ALL SELECT 'order_item', count(*) FROM {_L} UNION ALL SELECT 'nation', count(DISTINCT n_name) FROM {_O}",
    "unflatten_nodes": f"SELECT l_orderkey AS key, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_quantity) AS quantities FROM {_L} GROUP BY 1",
    "equal_documents": f"SELECT o_orderkey AS key, true AS equal FROM {_O}",
    "stream_load": "SELECT DISTINCT s_name AS supplier_name, s_acctbal::DECIMAL(18,2)::DOUBLE AS supplier_balance FROM supplier",
}
