import warnings

import pytest
from pyspark.sql import types as T

from tests.schemas import FILES, TREE, XS
from xylem import ConfigError, Model, SchemaError, parse_config
from xylem.functions.names import key_name, link_name, short_name
from xylem.plans.config import column_type


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("xsd")
    for name, text in FILES.items():
        (at / name).write_text(text)
    return at


def compiled(folder, config=None, schema=None, name="own.xsd", short="DocumentRoot"):
    """The model of the library, or of the schema parts given."""
    if schema is None:
        name = "library.xsd"
    else:
        (folder / name).write_text(f"<xs:schema {XS}>{schema}</xs:schema>")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Model(str(folder / name), short, config)


def names(folder, table, **config):
    return [f.name for f in compiled(folder, config).table(table).fields]


def test_library_tree(folder):
    assert compiled(folder).target_tree == TREE


def test_source_tree_holds_what_the_target_drops(folder):
    lines = compiled(folder).source_tree.split("\n")
    assert lines[0] == "library:" and "        place[1, 1] (choice):" in lines and "        appendix[0, 1]:" in lines and "            life[0, 1]:" in lines


def test_dropped_parts_are_told(folder):
    with pytest.warns(UserWarning) as told:
        Model(str(folder / "library.xsd"))
    assert {str(w.message) for w in told} >= {"xs:any is ignored", "work.after is recursive and is dropped"}


def test_tables_in_order_of_their_keys(folder):
    schemas = compiled(folder).schemas()
    assert set(schemas) == {"floor", "branch", "branch_floor", "creator", "copy", "work", "work_creator", "work_copy", "library", "library_branch", "library_work"}
    order = list(schemas)
    assert order.index("creator") < order.index("copy") < order.index("work") < order.index("library") and order.index("floor") < order.index("branch")
    assert schemas["copy"].names == ["pk_copy", "fk_owner_creator", "worth", "pages", "lent", "state", "due", "record_hash"] or "owner_fk_creator" in schemas["copy"].names
    kinds = {f.name: f.dataType for f in schemas["copy"]}
    assert [kinds[n] for n in ("worth", "pages", "lent", "due")] == [T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()]
    assert schemas["floor"]["level"].dataType == T.IntegerType() and schemas["creator"]["life_from"].dataType == T.ShortType()
    assert {c.name: c.ddl() for c in compiled(folder).table("branch").columns}["code"] == "VARCHAR(6)"


def test_long_names():
    assert short_name("n" * 63) == "n" * 63
    assert len(short_name("n" * 64)) == 63 != short_name("n" * 64) != short_name("n" * 65)
    assert key_name("fleet_ship", "ship") == "fk_fleet_ship" and key_name("tender", "ship") == "tender_fk_ship"
    assert link_name("fleet", "big_ship", "ship") == "fleet_big_ship" and link_name("fleet", "tender", "ship") == "fleet_tender_ship"


def test_diagram_and_statements(folder):
    model = compiled(folder, {"tables": {"floor": {"reuse": False, "extra_args": [{"name": "by_level"}]}}})
    diagram = model.erd().split("\n")
    assert '    work ||--|{ creator : "creator*"' in diagram and '    copy ||--o| creator : "owner"' in diagram and '    branch ||--o{ floor : "floor"' in diagram
    assert "        string-N given" in diagram
    statements = {s.split("`")[3]: s for s in model.create_statements("lib")}
    assert "  `pk_floor` BIGINT NOT NULL,\n  `fk_parent_branch` BIGINT,\n  `level` INT,\n  `shelves` BIGINT" in statements["floor"] and "record_hash" not in statements["floor"]
    assert {"table": "floor", "extra": {"name": "by_level"}} in model.index_hints()
    assert ["branch", "floor"] in [sorted(g) for g in model.groups()] and sorted(x for g in model.groups() for x in g) == sorted(t.name for t in model.tables)


def test_transforms(folder):
    field = lambda table, name, how: {"tables": {table: {"fields": {name: {"transform": how}}}}}
    assert "place" in names(folder, "branch", **field("branch", "place", False)) and "place_type" not in names(folder, "branch", **field("branch", "place", False))
    assert "lent" not in names(folder, "copy", **field("copy", "lent", "skip"))
    assert "owner_family" in names(folder, "copy", **field("copy", "owner", "elevate"))
    assert "family" in names(folder, "copy", **field("copy", "owner", "elevate_wo_prefix"))
    assert {"place_grid", "place_road", "place_tower"} <= set(names(folder, "branch", tables={"place": {"choice_transform": False}}))
    assert {"title", "place"} <= set(names(folder, "branch", transform=False))
    assert "title_value" in names(folder, "branch", transform=False, tables={"branch": {"fields": {"title": {"transform": "auto"}}}})


@pytest.mark.parametrize("config", [
    {"tables": {"attic": {}}}, {"tables": {"branch": {"fields": {"floor": {"transform": "elevate"}}}}}, {"tables": {"creator": {"reuse": False}}}, {"tables": {"library": {"reuse": False}}},
    {"tables": {"copy": {"choice_transform": True}}}, {"colour": 1}, {"tables": {"copy": {"reuse": "no"}}}, {"tables": {"copy": {"fields": {"worth": {"type": "Guilder"}}}}},
    {"tables": {"copy": {"fields": {"worth": {"transform": "none"}}}}}, {"tables": []}, {"metadata_columns": [{}]}, {"bad_values": "perhaps"}, {"record_hash_size": -1},
])
def test_config_errors(folder, config):
    with pytest.raises(ConfigError):
        compiled(folder, config)


def test_only_some_lists_can_be_joined(folder):
    schema = '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="n" type="xs:{}" maxOccurs="9"/></xs:sequence></xs:complexType></xs:element>'
    asked = {"tables": {"r": {"fields": {"n": {"transform": "join"}}}}}
    assert compiled(folder, asked, schema.format("date")).table("r").columns[0].many
    with pytest.raises(ConfigError, match="joined"):
        compiled(folder, asked, schema.format("boolean"))


def test_yaml():
    assert parse_config("") == {}
    config = parse_config("row_numbers: true\ntables:\n  copy:\n    reuse: false\n    fields:\n      worth: {type: String(50), rename: price}\n  work:\n")
    assert config["tables"]["copy"]["fields"]["worth"] == {"type": "String(50)", "rename": "price"}
    for bad in ("- a", "document_tree_hook: x", "tables: {a: {extra_args: x}}", "tables: {a: {fields: {b: {type: 1}}}}", "tables: {a: {fields: {b: {type: 'String('}}}}", "a: [", "tables: {a: {fields: {b: {transform: none}}}}"):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_column_types():
    assert column_type("Numeric(10, 2)") == T.DecimalType(10, 2) and column_type("DateTime(timezone=False)") == T.TimestampNTZType()
    assert column_type("String(5)") == T.StringType() and column_type("LargeBinary(20)") == T.BinaryType()


def test_several_roots_groups_and_derived_types(folder):
    schema = """
      <xs:element name="gauge"><xs:complexType mixed="true"><xs:sequence><xs:element name="read" type="xs:date" maxOccurs="3"/></xs:sequence><xs:attributeGroup ref="marks"/></xs:complexType></xs:element>
      <xs:element name="alarm" type="loud"/>
      <xs:attributeGroup name="marks"><xs:attribute name="unit" type="xs:short"/></xs:attributeGroup>
      <xs:group name="either"><xs:choice><xs:element name="bell" type="xs:boolean"/><xs:element name="lamp" type="xs:boolean"/></xs:choice></xs:group>
      <xs:complexType name="quiet"><xs:sequence><xs:element name="volume" type="level"/></xs:sequence></xs:complexType>
      <xs:complexType name="loud"><xs:complexContent><xs:extension base="quiet"><xs:sequence><xs:group ref="either"/><xs:element ref="gauge" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
      <xs:simpleType name="level"><xs:union memberTypes="xs:int xs:int"/></xs:simpleType>"""
    model = compiled(folder, None, schema, "several.xsd", "plant")
    assert model.root.source.virtual and model.root.name == "plant"
    assert model.source_tree.split("\n")[:6] == ["plant:", "    alarm[1, 1]:", "        volume[1, 1]: int", "        bell[0, 1]: boolean", "        lamp[0, 1]: boolean", "        gauge[0, None]:"]
    assert {f.name for f in model.table("gauge").fields} == {"unit", "read", "value"}


def test_broken_schemas(folder):
    for schema in (" ", '<xs:element name="a" type="none"/>'):
        with pytest.raises(SchemaError):
            compiled(folder, None, schema, "broken.xsd")
    (folder / "other.xsd").write_text("<a/>")
    with pytest.raises(SchemaError):
        Model(str(folder / "other.xsd"))
