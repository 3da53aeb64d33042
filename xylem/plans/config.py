"""Model configuration: YAML or a mapping, checked before use."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping
from typing import Any

import yaml
from pyspark.sql import types as T

from xylem.errors import ConfigError

#: Names of column types in configurations, and their Spark types.
TYPES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Text": T.StringType(),
    "Integer": T.IntegerType(),
    "BigInteger": T.LongType(),
    "SmallInteger": T.ShortType(),
    "Float": T.DoubleType(),
    "Double": T.DoubleType(),
    "Numeric": T.DecimalType(38, 10),
    "Boolean": T.BooleanType(),
    "DateTime": T.TimestampType(),
    "Date": T.DateType(),
    "Time": T.StringType(),
    "LargeBinary": T.BinaryType(),
    "JSON": T.StringType(),
    "Uuid": T.StringType(),
    "UUID": T.StringType(),
}
#: The keys of each part of a configuration.
MODEL_KEYS = ("as_columnstore", "row_numbers", "document_tree_hook", "document_tree_node_hook", "record_hash_column_name", "record_hash_constructor", "record_hash_size", "bad_values", "metadata_columns", "transform", "tables")
TABLE_KEYS = ("reuse", "as_columnstore", "choice_transform", "extra_args", "fields")
FIELD_KEYS = ("type", "rename", "transform")
FIELD_TRANSFORMS = (False, "auto", "skip", "join", "elevate", "elevate_wo_prefix")
CALLABLE_KEYS = ("document_tree_hook", "document_tree_node_hook", "record_hash_constructor", "extra_args")


def column_type(text: str | T.DataType) -> T.DataType:
    """The Spark type of a configured type, like `String(50)` or `Numeric(10, 2)`."""
    if isinstance(text, T.DataType):
        return text
    if not isinstance(text, str):
        raise ConfigError(f"a type is written as text, not {text!r}")
    found = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not found or found[1] not in TYPES:
        raise ConfigError(f"unknown type {text!r}")
    try:
        call = ast.parse(f"f({found[2] or ''})", mode="eval").body
        args = [ast.literal_eval(a) for a in call.args]
        named = {k.arg: ast.literal_eval(k.value) for k in call.keywords}
    except (SyntaxError, ValueError) as e:
        raise ConfigError(f"malformed type {text!r}") from e
    if found[1] == "Numeric" and args:
        return T.DecimalType(*args[:2]) if len(args) > 1 else T.DecimalType(args[0], 0)
    if found[1] == "DateTime" and named.get("timezone") is False:
        return T.TimestampNTZType()
    if found[1] in ("String", "LargeBinary") and any(not isinstance(a, int) for a in args):
        raise ConfigError(f"malformed type {text!r}")
    return TYPES[found[1]]


def type_length(text: Any) -> int | None:
    found = re.fullmatch(r"\s*String\s*\(\s*(\d+)\s*\)\s*", text) if isinstance(text, str) else None
    return int(found[1]) if found else None


def _mapping(value: Any, what: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise ConfigError(f"{what} must be a mapping")
    return dict(value)


def _known(part: dict, keys: tuple[str, ...], what: str) -> None:
    for k in part:
        if k not in keys:
            raise ConfigError(f"{what}: unknown key {k!r}")


def checked(config: Mapping | None) -> dict:
    """A copy of the configuration with every part present as a mapping."""
    out = _mapping(config, "the configuration")
    _known(out, MODEL_KEYS, "model")
    if out.get("transform", "auto") not in (True, False, "auto", None):
        raise ConfigError("transform must be auto or false")
    if out.get("bad_values", "error") not in ("error", "null"):
        raise ConfigError("bad_values must be error or null")
    size = out.get("record_hash_size")
    if size is not None and (not isinstance(size, int) or size < 1):
        raise ConfigError("record_hash_size must be a number of bytes")
    for c in out.get("metadata_columns") or ():
        if not isinstance(c, Mapping) or "name" not in c:
            raise ConfigError("a metadata column needs a name")
        column_type(c.get("type", "String"))
        _known(dict(c), ("name", "type", "default"), f"metadata column {c['name']}")
    tables = {}
    for name, table in _mapping(out.get("tables"), "tables").items():
        table = _mapping(table, f"table {name}")
        _known(table, TABLE_KEYS, f"table {name}")
        if table.get("choice_transform", "auto") not in (True, False, "auto"):
            raise ConfigError(f"table {name}: choice_transform must be auto, true or false")
        if table.get("reuse", True) not in (True, False):
            raise ConfigError(f"table {name}: reuse must be true or false")
        fields = {}
        for field, options in _mapping(table.get("fields"), f"fields of {name}").items():
            options = _mapping(options, f"field {name}.{field}")
            _known(options, FIELD_KEYS, f"field {name}.{field}")
            if options.get("transform", "auto") not in FIELD_TRANSFORMS:
                raise ConfigError(f"field {name}.{field}: unknown transform {options['transform']!r}")
            if "type" in options:
                column_type(options["type"])
            if not isinstance(options.get("rename", ""), str):
                raise ConfigError(f"field {name}.{field}: rename must be text")
            fields[field] = options
        tables[name] = table | {"fields": fields}
    return out | {"tables": tables}


def parse_config(text: str) -> dict:
    """A configuration from YAML; hooks and other callables can't be written in YAML."""
    try:
        loaded = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"malformed YAML: {e}") from e
    if loaded is None:
        return {}
    config = _mapping(loaded, "the configuration")
    for part in (config, *(t for t in (config.get("tables") or {}).values() if isinstance(t, Mapping))):
        for k in CALLABLE_KEYS:
            if k in part:
                raise ConfigError(f"{k} can't be given in YAML")
    for name, table in (config.get("tables") or {}).items():
        for field, options in ((table or {}).get("fields") or {}).items():
            if options and "type" in options and not isinstance(options["type"], str):
                raise ConfigError(f"field {name}.{field}: a type is written as text")
    checked(config)
    return config


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())
