import warnings
import xml.etree.ElementTree as ET
from datetime import UTC

import pytest
from pyspark.sql import functions as F

from tests.schemas import DOCUMENTS, FILES, LIBRARIES, links, rows, text
from xylem import ConfigError, DataModel, cli
from xylem.functions.text import join_values, split_values, strip_blank
from xylem.operators.merge import numbered
from xylem.sources import reader
from xylem.sources.reader import repair


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("shred")
    for name, schema in FILES.items():
        (at / name).write_text(schema)
    (at / "in").mkdir()
    for k, doc in enumerate(DOCUMENTS):
        (at / "in" / f"{k}.xml").write_text(f"<?xml version='1.0'?>\n{doc}")
    return at


def data_model(spark, folder, store, config=None, **more):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return DataModel(str(folder / "library.xsd"), model_config=config, connection_string=str(store), db_engine=spark, **more)


def files(folder):
    return str(folder / "in" / "*.xml")


def canonical(xml):
    root = ET.fromstring(xml.split("?>", 1)[-1])
    for worth in root.iter("worth"):
        worth.text = f"{float(worth.text):g}"
    return ET.canonicalize(ET.tostring(root), strip_text=True)


def test_values(spark):
    lists = [(["a", "b"],), (['x,"y"', "back\\slash", "plain"],), (["one,two"],), (["l\nm"],), ([],), (None,)]
    df = spark.createDataFrame(lists, "v array<string>").select("v", join_values(F.col("v")).alias("j"))
    for r in df.select("v", "j", split_values(F.col("j")).alias("s")).collect():
        assert r.s == (r.v or None)
    assert df.collect()[1].j == '"x,\\"y\\"","back\\\\slash",plain'
    assert spark.createDataFrame([(" a ",), (" ",), (None,)], "t string").select(strip_blank(F.col("t"))).collect() == [("a",), (None,), (None,)]


def test_numbering(spark):
    df = spark.range(1000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("k__"))
    got = [(r.k__, r.pk__) for r in numbered(df, 7).orderBy("k__").collect()]
    assert [n for _, n in got] == list(range(7, 1007))


def test_rows_are_those_of_the_plain_shredder(spark, folder, tmp_path):
    doc = data_model(spark, folder, tmp_path).parse_xml(files(folder))
    staged, expected = doc.doc_tree_to_flat_data(), rows()
    assert doc.counts() == {name: len(x) for name, x in expected.items()}
    assert {name: df.count() for name, df in staged.links.items()} == links()
    table = lambda name, *columns: {tuple(r) for r in staged.records(staged.model.table(name)).select(*columns).collect()}
    assert table("floor", "level", "shelves") == expected["floor"]
    assert table("creator", "family", "given", "life_from", "life_to") == expected["creator"]
    assert table("branch", "code", "title_script", "title_value", "place_type", "place_value", "day", "hours") == expected["branch"]
    assert table("work", "key", "title_attr", "title_script", "title_value", "tongues") == expected["work"]
    people = {r.k__: (r.family, r.given, r.life_from, r.life_to) for r in staged.records(staged.model.table("creator")).collect()}
    copies = staged.records(staged.model.table("copy"))
    owner = next(c for c in copies.columns if "creator" in c)
    assert {(people.get(r[owner]), r.worth, r.pages, r.lent, r.state, r.due and r.due.replace(tzinfo=UTC)) for r in copies.collect()} == expected["copy"]


@pytest.mark.parametrize("config", [
    {"row_numbers": True}, {"row_numbers": True, "tables": {"copy": {"reuse": False}}, "record_hash_constructor": "md5"},
    {"row_numbers": True, "tables": {"branch": {"fields": {"place": {"transform": False}}}, "place": {"choice_transform": False}}},
])
def test_load_twice_and_round_trip(spark, folder, tmp_path, config):
    model = data_model(spark, folder, tmp_path, config)
    first = model.parse_xml(files(folder)).insert_into_target_tables()
    assert first.inserted["library"] == 2 and first.inserted["library_branch"] == 3 and first.inserted["floor"] == 2
    assert first.inserted["work"] == 2  # the order of copies and zeros behind the point make no other work
    second = model.parse_xml(files(folder)).insert_into_target_tables()
    assert sum(second.inserted.values()) == 0 and second.existing["library"] == 2 and second.lost_values == 0
    got = model.extract_from_database("opened = '2001-01-01'", force_tz="UTC").to_xml().collect()
    assert len(got) == 1
    # works are held once: the first library's order of copies may stand for both
    orders = {canonical(text(LIBRARIES[1] | {"works": [w]})) for w in (LIBRARIES[0]["works"][0], LIBRARIES[1]["works"][0])}
    assert canonical(got[0].xml) in orders


def test_metadata_hooks_and_catalog(spark, folder, tmp_path):
    config = {"metadata_columns": [{"name": "origin", "type": "String(9)"}], "document_tree_hook": lambda docs: docs.where("doc.opened = '1999-12-31'"), "document_tree_node_hook": lambda name, df: df.withColumn("state", F.upper("state")) if name == "copy" else df}
    model = data_model(spark, folder, tmp_path, config, db_type="catalog", db_schema="readers")
    model.parse_xml(files(folder), {"origin": "here"}).insert_into_target_tables()
    assert [r.origin for r in spark.table("readers.library").collect()] == ["here"]
    assert {r.state for r in spark.table("readers.copy").collect()} == {"FINE", "WORN"}
    with pytest.raises(ValueError, match="metadata"):
        model.parse_xml(DOCUMENTS[0].encode(), {"other": 1})
    model.drop_all_tables()
    spark.sql("DROP DATABASE readers CASCADE")


def test_equal_documents(spark, folder, tmp_path):
    model = data_model(spark, folder, tmp_path)
    one = DOCUMENTS[0]
    variants = [one, one.replace("<tongues>", "<after><title>x</title></after><tongues>  "), one.replace("</work>", "<appendix><any/></appendix></work>", 1), one.replace("<worth>", "<unknown>1</unknown><worth> "), one.replace("<library>", "<l:library xmlns:l='urn:l'>").replace("</library>", "</l:library>")]
    docs = spark.createDataFrame([(v,) for v in variants], "xml string")
    assert model.parse_xml(docs).docs.select("doc.h__").distinct().count() == 1


@pytest.mark.parametrize("kind", ["good", "invalid", "junk", "cut"])
@pytest.mark.parametrize("validate", [False, True])
@pytest.mark.parametrize("recover", [False, True])
def test_validation_matrix(spark, folder, tmp_path, kind, validate, recover):
    doc = {"good": DOCUMENTS[0], "invalid": '<library><branch code="X"/></library>', "junk": DOCUMENTS[0] + "Hello", "cut": DOCUMENTS[0].replace("</family>", "", 1)}[kind]
    fine = {"good": True, "invalid": not validate, "junk": recover, "cut": recover and not validate}[kind]
    parsed = data_model(spark, folder, tmp_path).parse_xml(doc.encode(), skip_validation=not validate, recover=recover)
    if fine:
        assert parsed.docs.count() == 1
        parsed.docs.collect()
    else:
        with pytest.raises(Exception, match="malformed or invalid"):
            parsed.docs.collect()


def test_rows_by_tag_and_time_zones(spark, folder, tmp_path):
    from xylem.operators.shape import shaped

    model = data_model(spark, folder, tmp_path, {"row_numbers": "place"})
    by_tag = shaped(model.plan, reader.read_rows(spark, model.plan, files(folder), xsd=str(folder / "library.xsd")))
    whole = model.parse_xml(files(folder))
    assert sorted(r[0] for r in by_tag.select("doc.h__").collect()) == sorted(r[0] for r in whole.docs.select("doc.h__").collect())
    whole.insert_into_target_tables()
    assert "place" in model.store.read("library_work", model.plan.schemas()["library_work"]).columns
    assert "<due>2024-03-01T11:00:00.000+01:00</due>" in model.extract_from_database(force_tz="Europe/Paris").to_xml().first().xml
    model.extract_from_database("opened = '1999-12-31'").to_xml(str(tmp_path / "a.xml"))
    assert (tmp_path / "a.xml").read_text().startswith("<?xml")


def test_parsed_documents_as_xml(spark, folder, tmp_path):
    doc = data_model(spark, folder, tmp_path).parse_xml(DOCUMENTS[1].encode())
    assert "h__" not in doc.flat_data_to_doc_tree().schema.simpleString()
    assert canonical(doc.to_xml(indent=None).first().xml) == canonical(DOCUMENTS[1].replace("+00:00", "Z"))


def test_repr_counts(spark, folder, tmp_path):
    doc = data_model(spark, folder, tmp_path).parse_xml(files(folder))
    assert "creator: 3" in repr(doc) and "library: 2" in repr(doc)


def test_repair():
    assert repair("<a><b>x & y</a>") == "<a><b>x &amp; y</b></a>"
    assert repair("<a b='1'>1 < 2</c></a>junk<d/>") == "<a b='1'>1 &lt; 2</a>"
    assert repair("<a><!-- <x> --><![CDATA[<y>]]><z/>") == "<a><!-- <x> --><![CDATA[<y>]]><z/></a>"


def test_bad_values_are_told(spark, folder, tmp_path):
    """A value that isn't of its type is an error unless nulls are asked for; those are counted."""
    bad = DOCUMENTS[0].replace("<pages>12</pages>", "<pages>a dozen</pages>").replace('to="1852"', 'to="99999"')
    with pytest.raises(Exception, match="a dozen|99999"):
        data_model(spark, folder, tmp_path / "a").parse_xml(bad.encode()).insert_into_target_tables()
    model = data_model(spark, folder, tmp_path / "b", {"bad_values": "null"})
    stats = model.parse_xml(bad.encode()).insert_into_target_tables()
    assert stats.lost_values == 2
    copies = model.store.read("copy", model.plan.schemas()["copy"])
    assert sorted((r.pages for r in copies.collect()), key=repr) == [5_000_000_000, 7, None]
    huge = DOCUMENTS[0].replace("<pages>12</pages>", f"<pages>{10**30}</pages>")
    with pytest.raises(Exception, match=str(10**30)):
        data_model(spark, folder, tmp_path / "c").parse_xml(huge.encode()).insert_into_target_tables()
    wide = data_model(spark, folder, tmp_path / "d", {"tables": {"copy": {"fields": {"pages": {"type": "Numeric(38, 0)"}}}}})
    wide.parse_xml(huge.encode()).insert_into_target_tables()
    assert wide.store.read("copy", wide.plan.schemas()["copy"]).where(f"pages = {10**30}BD").count() == 1


def test_first_piece_of_mixed_text(spark, tmp_path):
    (tmp_path / "m.xsd").write_text("""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType mixed="true"><xs:sequence>
      <xs:element name="n" type="xs:string" minOccurs="0"/><xs:element name="d" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>""")
    model = DataModel(str(tmp_path / "m.xsd"), connection_string=str(tmp_path / "s"), db_engine=spark)
    texts = ["<r>first<n>1</n>mid<d>2</d>last</r>", "<r><n>1</n>mid<d>2</d></r>", "<r>only</r>", "<r> <n>1</n></r>", "<r>a &amp; b<n>1</n>c</r>"]
    docs = model.parse_xml(spark.createDataFrame([(t,) for t in texts], "xml string")).docs
    assert [r.value for r in docs.select("doc.value").collect()] == ["first", None, "only", None, "a & b"]


def test_texts_are_parsed_once(spark, folder, tmp_path):
    doc = data_model(spark, folder, tmp_path).parse_xml(files(folder))
    staged = doc.doc_tree_to_flat_data()
    plan = staged.records(staged.model.root)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1


def test_hash_size_and_constructor(spark, folder, tmp_path):
    import hashlib

    sizes = {}
    for name, config in {"sha1": {}, "cut": {"record_hash_size": 8}, "md5": {"record_hash_constructor": hashlib.md5}, "sha512": {"record_hash_constructor": "sha512", "record_hash_size": 32}}.items():
        model = data_model(spark, folder, tmp_path / name, config)
        model.parse_xml(files(folder)).insert_into_target_tables()
        got = model.store.read("creator", model.plan.schemas()["creator"]).collect()
        sizes[name] = {len(r.record_hash) for r in got}
        assert len({bytes(r.record_hash) for r in got}) == 3
    assert sizes == {"sha1": {20}, "cut": {8}, "md5": {16}, "sha512": {32}}
    with pytest.raises(ConfigError):
        data_model(spark, folder, tmp_path, {"record_hash_constructor": "crc"}).parse_xml(files(folder))


def test_failed_load_leaves_nothing(spark, folder, tmp_path):
    model = data_model(spark, folder, tmp_path)
    doc = model.parse_xml(files(folder))
    from xylem.sources.store import ParquetStore

    def broken(self, *args):
        raise RuntimeError("lost")

    ParquetStore.commit, kept = broken, ParquetStore.commit
    try:
        with pytest.raises(RuntimeError):
            doc.insert_into_target_tables()
    finally:
        ParquetStore.commit = kept
    assert all(model.store.read(n, s).count() == 0 for n, s in model.plan.schemas().items())


def test_two_loads_at_once(spark, folder, tmp_path):
    """A load that another overtook starts again from what is there: keys stay unique, nothing is there twice."""
    from xylem.sources.store import ParquetStore

    first, second = (data_model(spark, folder, tmp_path) for _ in range(2))
    overtaken, real = [], ParquetStore.commit

    def late(self, *args):
        if not overtaken:
            overtaken.append(True)
            second.parse_xml(files(folder)).insert_into_target_tables()
        return real(self, *args)

    ParquetStore.commit = late
    try:
        stats = first.parse_xml(files(folder)).insert_into_target_tables()
    finally:
        ParquetStore.commit = real
    assert sum(stats.inserted.values()) == 0 and stats.existing["library"] == 2
    for name, schema in first.plan.schemas().items():
        got = first.store.read(name, schema)
        if schema.names[0].startswith("pk_"):
            assert got.count() == got.select(schema.names[0]).distinct().count() == len(rows()[name])


def test_loads_in_threads(spark, folder, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def load(k):
        model = data_model(spark, folder, tmp_path / "store")
        one = LIBRARIES[0] | {"opened": f"200{k}-01-01"}
        return model.parse_xml(text(one).encode()).insert_into_target_tables()

    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(load, range(3)))
    model = data_model(spark, folder, tmp_path / "store")
    tables = {n: model.store.read(n, s) for n, s in model.plan.schemas().items()}
    assert sum(x.inserted["library"] for x in done) == 3 == tables["library"].select("pk_library").distinct().count()
    assert sum(x.inserted["work"] for x in done) == 2 == tables["work"].count() and tables["creator"].count() == 3


def test_compaction(spark, folder, tmp_path):
    model = data_model(spark, folder, tmp_path)
    for k in range(3):
        model.parse_xml(text(LIBRARIES[0] | {"opened": f"200{k}-01-01"}).encode()).insert_into_target_tables()
    schemas = model.plan.schemas()
    before = {n: sorted(map(tuple, model.store.read(n, s).collect()), key=repr) for n, s in schemas.items()}
    assert len(model.store.loads()) == 3
    model.store.compact(schemas)
    assert len(model.store.loads()) == 1
    assert before == {n: sorted(map(tuple, model.store.read(n, s).collect()), key=repr) for n, s in schemas.items()}
    assert sum(model.parse_xml(text(LIBRARIES[0] | {"opened": "2000-01-01"}).encode()).insert_into_target_tables().inserted.values()) == 0


def test_command_line(folder, tmp_path, capsys, spark):
    xsd = str(folder / "library.xsd")
    assert cli.main(["render", xsd]) == 0 and capsys.readouterr().out.startswith("library:")
    assert cli.main(["render", xsd, "--what", "ddl"]) == 0 and "CREATE TABLE" in capsys.readouterr().out
    assert cli.main(["import", xsd, str(folder / "in" / "0.xml"), "--store", str(tmp_path / "s")]) == 0 and "library: 1 new" in capsys.readouterr().out
    assert cli.main(["render", str(folder / "none.xsd")]) == 1 and "error:" in capsys.readouterr().err


def test_explorer(folder, tmp_path):
    config = tmp_path / "c.yaml"
    config.write_text("row_numbers: true\n")
    explorer = cli.Explorer(str(folder / "library.xsd"), "library", str(config))
    good = explorer.good["ddl"]
    explorer.update("tables: {none: {}}")
    explorer.save()
    assert explorer.error and explorer.good["ddl"] == good and config.read_text() == "row_numbers: true\n"
    explorer.update("tables: {copy: {reuse: false}}")
    explorer.save()
    assert not explorer.error and "reuse" in config.read_text() and "fk_parent_work" in explorer.page()


def test_staged_documents_do_not_move(spark, folder, tmp_path):
    """Repeats are dropped when documents are staged: links and children are read from the files without an exchange of documents."""
    doc = data_model(spark, folder, tmp_path).parse_xml(files(folder))
    doc.insert_into_temp_tables()
    staged = doc.doc_tree_to_flat_data()
    plan = staged.links["library_branch"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert doc.counts() == {name: len(x) for name, x in rows().items()}


def test_repeated_documents_are_staged_once(spark, folder, tmp_path):
    model = data_model(spark, folder, tmp_path)
    doc = model.parse_xml(files(folder))
    doc.parse_xml(files(folder))
    stats = doc.insert_into_target_tables()
    assert stats.inserted["library"] == 2 and stats.inserted["library_branch"] == 3
    assert model.store.read("library", model.plan.schemas()["library"]).select("pk_library").distinct().count() == 2
