import os
import subprocess
import sys
import warnings
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import types as T

from tests.schemas import DOCUMENTS, FILES, LIBRARIES, text
from xylem import ConfigError, DataModel, cli, queries
from xylem.plans import dialects
from xylem.sources import databases

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS = [
    (1, "plain", True, datetime(2024, 3, 1, 10, 0, 0, 123456, UTC), bytearray(b"\xde\xad\xbe\xef"), 2.5),
    (2, 'back\\slash\ttab\nline\r "quoted", comma', False, None, None, -1e30),
    (3, "\\N", None, None, bytearray(b""), None),
    (4, "", None, None, None, None),
    (5, None, None, None, None, None),
]
STRUCT = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("flag", T.BooleanType()), T.StructField("ts", T.TimestampType()), T.StructField("hash", T.BinaryType()), T.StructField("n", T.DoubleType())])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("databases")
    for name, schema in FILES.items():
        (at / name).write_text(schema)
    return at


def library(spark, folder, store, config=None):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return DataModel(str(folder / "library.xsd"), model_config=config, connection_string=str(store), db_engine=spark)


def encoded(spark, name):
    return [r.value for r in dialects.lines(spark.createDataFrame(ROWS, STRUCT), dialects.dialect(name)).collect()]


def test_encodings(spark):
    assert encoded(spark, "postgresql")[:3] == [
        "1\tplain\tt\t2024-03-01 10:00:00.123456+00:00\t\\\\xDEADBEEF\t2.5",
        '2\tback\\\\slash\\ttab\\nline\\r "quoted", comma\tf\t\\N\t\\N\t-1.0E30',
        "3\t\\\\N\t\\N\t\\N\t\\\\x\t\\N",
    ]
    assert encoded(spark, "mysql")[0] == "1\tplain\t1\t2024-03-01 10:00:00.123456\tDEADBEEF\t2.5"
    assert encoded(spark, "mssql")[0].split("\x1f") == ["1", "plain", "1", "2024-03-01 10:00:00.123456 +00:00", "DEADBEEF", "2.5"]
    assert [x.split("\x1f")[1] for x in encoded(spark, "mssql")][3:] == ["\x00", ""]
    assert encoded(spark, "duckdb")[1].startswith('2,"back\\slash\ttab\nline\r ""quoted"", comma",false,,,')
    bad = spark.createDataFrame([("a\x1fb",)], "label string")
    with pytest.raises(Exception, match="separator"):
        dialects.lines(bad, dialects.dialect("mssql")).collect()


def test_duckdb_reads_what_is_written(spark, tmp_path):
    """25,000 plain rows before a quoted one, and all odd values."""
    many = [(k, f"row {k}", None, None, None, None) for k in range(10, 25_010)] + [(25_010, 'val,ue "x"', None, None, None, None)]
    d = dialects.dialect("duckdb")
    files = databases.written_files(spark.createDataFrame([*ROWS, *many], STRUCT).coalesce(2), d, str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute('CREATE TABLE "t" (' + ", ".join(f'"{f.name}" {d.column_type(f.dataType)}' for f in STRUCT) + ")")
    con.execute(dialects.load_statement("t", STRUCT, files, d))
    got = con.execute("SELECT * EXCLUDE ts, epoch_us(ts) FROM t WHERE id < 10 OR id = 25010 ORDER BY id").fetchall()
    at = int(ROWS[0][3].timestamp()) * 10**6 + 123456
    assert got == [(r[0], r[1], r[2], None if r[4] is None else bytes(r[4]), r[5], at if r[3] else None) for r in [*ROWS, many[-1]]]
    assert con.execute("SELECT count(*) FROM t").fetchone()[0] == len(many) + len(ROWS)


def test_load_statements():
    statement = lambda name: dialects.load_statement("t", STRUCT, "/f", dialects.dialect(name), "s")
    assert statement("postgresql") == """COPY "s"."t" ("id", "label", "flag", "ts", "hash", "n") FROM '/f' WITH (FORMAT text, ENCODING 'UTF8')"""
    assert "(`id`, `label`, `flag`, `ts`, @h4, `n`) SET `hash` = UNHEX(@h4)" in statement("mysql")
    assert statement("mssql")[:4] == ["bcp", "[s].[t]", "in", "/f"] and "10000" in statement("mssql")


def test_policy(monkeypatch):
    monkeypatch.setattr(dialects.shutil, "which", lambda tool: None)
    assert not dialects.in_bulk(dialects.dialect("mssql"), 10**6)
    with pytest.raises(RuntimeError, match="bcp"):
        dialects.in_bulk(dialects.dialect("mssql"), 10, True)
    monkeypatch.setattr(dialects.shutil, "which", lambda tool: f"/bin/{tool}")
    bulk = lambda name, n, **more: dialects.in_bulk(dialects.dialect(name), n, **more)
    assert [bulk("mssql", n) for n in (99, 100)] == [False, True] and bulk("postgresql", 0) and [bulk("duckdb", n) for n in (99, 100)] == [False, True]
    assert not bulk("mysql", 10**6, bulk_load=False) and bulk("mysql", 5, threshold=5) and bulk("mysql", 0, bulk_load=True)
    with pytest.raises(ConfigError):
        dialects.dialect("paper")


def test_statements(spark, folder, tmp_path):
    model = library(spark, folder, tmp_path, {"metadata_columns": [{"name": "origin", "type": "String(9)", "default": "it's"}], "tables": {"floor": {"reuse": False, "extra_args": [{"name": "by_level", "columns": ["level"]}]}}}).plan
    every = {name: "\n".join(dialects.create_statements(model, d, "lib")) for name, d in dialects.DIALECTS.items()}
    assert '"worth" DOUBLE PRECISION' in every["postgresql"] and '"due" TIMESTAMP WITH TIME ZONE' in every["postgresql"] and '"code" VARCHAR(6)' in every["postgresql"] and '"record_hash" BYTEA' in every["postgresql"]
    assert "`due` DATETIME(6)" in every["mysql"] and "[given] NVARCHAR(MAX)" in every["mssql"] and "[lent] BIT" in every["mssql"]
    assert """"origin" VARCHAR(1000) DEFAULT 'it''s'""" in every["postgresql"]
    assert 'FOREIGN KEY ("fk_parent_branch") REFERENCES "lib"."branch" ("pk_branch")' in every["postgresql"] and 'PRIMARY KEY ("pk_floor")' in every["postgresql"]
    indexes = dialects.index_statements(model, dialects.dialect("postgresql"), "lib")
    assert 'CREATE UNIQUE INDEX "ix_creator_record_hash" ON "lib"."creator" ("record_hash")' in indexes
    assert 'CREATE INDEX "by_level" ON "lib"."floor" ("level")' in indexes and 'CREATE INDEX "ix_floor_fk_parent_branch" ON "lib"."floor" ("fk_parent_branch")' in indexes


def test_statements_run(spark, folder, tmp_path):
    """All tables and indexes can be made in the database that is at hand."""
    con, d = duckdb.connect(), dialects.dialect("duckdb")
    model = library(spark, folder, tmp_path).plan
    by_name = dict(zip(model.schemas(), dialects.create_statements(model, d), strict=True))
    for name, _ in databases._ordered(dict.fromkeys(by_name), model):
        con.execute(by_name[name])
    for statement in dialects.index_statements(model, d):
        con.execute(statement)


@pytest.mark.parametrize("kind", ["duckdb", "derby"])
def test_copies_grow_with_the_store(spark, folder, tmp_path, kind):
    model = library(spark, folder, tmp_path / "store", {"row_numbers": True})
    target = str(tmp_path / "copy.duckdb") if kind == "duckdb" else f"jdbc:derby:memory:{tmp_path.name};create=true"
    options = {} if kind == "duckdb" else {"properties": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}}
    expected = {}
    for doc in (DOCUMENTS[0], DOCUMENTS[0], DOCUMENTS[1], text(LIBRARIES[0] | {"opened": "1888-08-08"})):
        stats = model.parse_xml(doc.encode()).insert_into_target_tables()
        added = model.copy_to(kind, target, **options)
        assert added == {n: stats.inserted[n] for n in added} and set(added) == set(stats.inserted)
        expected = {n: expected.get(n, 0) + added[n] for n in added}
    for name, schema in model.plan.schemas().items():
        rows = sorted(map(tuple, model.store.read(name, schema).collect()), key=repr)
        assert len(rows) == expected[name]
        if kind == "duckdb":
            con = duckdb.connect(target)
            got = con.execute(f'SELECT count(*), count(DISTINCT "{schema.names[0]}") FROM "{name}"').fetchone()
            con.close()
        else:
            got = spark.read.jdbc(target, f'"{name}"', properties=options["properties"])
            got = (got.count(), got.select(schema.names[0]).distinct().count())
        assert got == (len(rows), len({r[0] for r in rows}))


def test_files_for_a_client(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(dialects.shutil, "which", lambda tool: f"/bin/{tool}")
    model = library(spark, folder, tmp_path / "store")
    model.parse_xml(DOCUMENTS[0].encode()).insert_into_target_tables()
    out = databases.load_files(model.store, model.plan, "postgresql", str(tmp_path / "out"), ["true"])
    assert set(out) == set(model.plan.schemas()) and list(out).index("creator") < list(out).index("copy") and all(s.startswith("COPY ") for x in out.values() for s in x)
    with pytest.raises(RuntimeError):
        databases.load_files(model.store, model.plan, "postgresql", str(tmp_path / "out2"), ["false"])
    assert databases.load_files(model.store, model.plan, "mysql", str(tmp_path / "out3")) == {}  # few rows


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["render", str(folder / "library.xsd"), "--what", "ddl", "--dialect", "mssql"]) == 0
    shown = capsys.readouterr().out
    assert "CREATE TABLE [creator]" in shown and "CREATE UNIQUE INDEX [ix_creator_record_hash]" in shown


def test_copy_from_a_cluster(tmp_path):
    """Executors are processes of their own and don't see what the driver has opened within its own."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from xylem import queries
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "4").getOrCreate()
got = queries.database_copy(spark, "/root/testdata/sf0.001")
print("rows", got.count(), got.select("order_key").distinct().count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=600)
    rows = duckdb.connect().execute("SELECT count(*), count(DISTINCT l_orderkey) FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE l_orderkey IN (SELECT o_orderkey FROM '/root/testdata/sf0.001/orders.parquet' WHERE o_custkey IN (SELECT c_custkey FROM '/root/testdata/sf0.001/customer.parquet'))").fetchone()
    assert f"rows {rows[0]} {rows[1]}" in done.stdout, done.stderr[-2000:]


def test_query_copies_after_each_load(spark, sf, monkeypatch):
    added, real = [], databases.to_jdbc
    monkeypatch.setattr(databases, "to_jdbc", lambda *args: added.append(real(*args)) or added[-1])
    queries.database_copy(spark, sf)
    assert len(added) == 2 and all(a["order"] > 0 and a["order_item"] > 0 for a in added)


def test_copies_have_indexes(spark, folder, tmp_path):
    model, url = library(spark, folder, tmp_path / "store", {"row_numbers": True}), f"jdbc:derby:memory:{tmp_path.name}"
    model.parse_xml(DOCUMENTS[0].encode()).insert_into_target_tables()
    for _ in range(2):
        model.copy_to("derby", f"{url};create=true", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    found, indexed = con.getMetaData().getIndexInfo(None, None, "creator", True, False), set()
    while found.next():
        indexed.add(found.getString("COLUMN_NAME"))
    con.close()
    assert indexed == {"pk_creator", "record_hash"}
