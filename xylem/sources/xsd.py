"""XSD compiler: schema files to a graph of complex types with ordered fields.

Covers named and anonymous types, nested and repeated sequence, choice and all, element, group,
attribute and attributeGroup references, simple and complex content derivation, mixed content,
restriction, list, union and enumeration, import and include. xs:any is ignored and a recursive
field dropped, both with a warning.
"""

from __future__ import annotations

import os
import warnings
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from xylem.errors import SchemaError

XS = "{http://www.w3.org/2001/XMLSchema}"
#: Base types whose enumerated values set the length.
ENUMERATED = ("string", "NMTOKEN", "duration", "token")


@dataclass(frozen=True)
class SimpleType:
    """base: local name of the built-in type; lengths of its text, None if unbounded."""

    base: str
    min_length: int = 0
    max_length: int | None = None


@dataclass
class Field:
    """A child element, an attribute or text content of a complex type."""

    name: str
    occurs: tuple[int, int | None]
    type: SimpleType | ComplexType
    attribute: bool = False
    content: bool = False
    suffixed: bool = False
    group: int | None = None

    @property
    def many(self) -> bool:
        return self.occurs[1] != 1

    @property
    def column(self) -> str:
        return f"{self.name}_attr" if self.suffixed else self.name


@dataclass
class ComplexType:
    name: str
    table: str
    fields: list[Field] = field(default_factory=list)
    choice: bool = False
    #: Several global elements: their common parent, which no document contains.
    virtual: bool = False
    mixed: bool = False


@dataclass
class _Part:
    """A component of a schema document with the prefixes of its file."""

    node: ET.Element
    prefixes: dict[str, str]
    space: str


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Schema:
    """All components of a schema file and what it imports and includes."""

    def __init__(self, path: str, base_url: str | None = None):
        self.parts: dict[tuple[str, str, str], _Part] = {}
        self._read: set[str] = set()
        self.files: list[str] = []
        self.order: list[tuple[str, str]] = []
        self._load(path, base_url or os.path.dirname(os.path.abspath(path)), None)
        self.types: dict[int, ComplexType] = {}
        self.tables: dict[str, int] = {}

    def _load(self, path: str, base: str, space: str | None) -> None:
        full = path if os.path.isabs(path) else (path if space is None and os.path.exists(path) else os.path.join(base, path))
        if os.path.abspath(full) in self._read:
            return
        self._read.add(os.path.abspath(full))
        self.files.append(os.path.abspath(full))
        prefixes, root = {}, None
        try:
            for event, value in ET.iterparse(full, ("start-ns", "start")):
                if event == "start-ns":
                    prefixes.setdefault(*value)
                elif root is None:
                    root = value
        except (OSError, ET.ParseError) as e:
            raise SchemaError(f"{full}: {e}") from e
        if root is None or root.tag != f"{XS}schema":
            raise SchemaError(f"{full} is no XML schema")
        own = root.get("targetNamespace", space or "")
        for child in root:
            kind = _local(child.tag) if isinstance(child.tag, str) else ""
            if kind in ("import", "include", "redefine") and child.get("schemaLocation"):
                self._load(child.get("schemaLocation"), os.path.dirname(os.path.abspath(full)), "" if kind == "import" else own)
            elif child.get("name"):
                self.parts[kind, own, child.get("name")] = _Part(child, prefixes, own)
                if kind == "element" and space is None:
                    self.order.append((own, child.get("name")))

    def find(self, kind: str, name: str, part: _Part) -> _Part | None:
        """The component a qualified name stands for; None for a built-in type."""
        prefix, _, local = name.rpartition(":")
        space = part.prefixes.get(prefix, part.space if not prefix else "")
        if f"{{{space}}}" == XS:
            return None
        kinds = ("complexType", "simpleType") if kind == "type" else (kind,)
        for k in kinds:
            for s in (space, part.space, ""):
                if (k, s, local) in self.parts:
                    return self.parts[k, s, local]
        found = next((p for (k, _, n), p in self.parts.items() if k in kinds and n == local), None)
        if found is None:
            raise SchemaError(f"{kind} {name} isn't defined")
        return found

    # simple types

    def simple(self, part: _Part | None, name: str = "string") -> SimpleType:
        """part: a simpleType; None for the built-in `name`."""
        if part is None:
            return SimpleType(name.rpartition(":")[2])
        for child in part.node:
            kind = _local(child.tag)
            inner = _Part(child, part.prefixes, part.space)
            if kind == "restriction":
                return self._restricted(inner)
            if kind == "list":
                return SimpleType("string")
            if kind == "union":
                members = [self.simple_named(m, inner) for m in child.get("memberTypes", "").split()]
                members += [self.simple(_Part(c, part.prefixes, part.space)) for c in child if _local(c.tag) == "simpleType"]
                bases, longest = {m.base for m in members}, [m.max_length for m in members]
                return SimpleType(bases.pop() if len(bases) == 1 else "string", min((m.min_length for m in members), default=0), None if None in longest or not longest else max(longest))
        return SimpleType("string")

    def simple_named(self, name: str, part: _Part) -> SimpleType:
        found = self.find("type", name, part)
        if found is not None and _local(found.node.tag) == "complexType":
            return self._content_base(found)
        return self.simple(found, name)

    def _restricted(self, part: _Part) -> SimpleType:
        base = next((self.simple(_Part(c, part.prefixes, part.space)) for c in part.node if _local(c.tag) == "simpleType"), None)
        base = base or self.simple_named(part.node.get("base", "xs:string"), part)
        values = {}
        for c in part.node:
            values.setdefault(_local(c.tag), []).append(c.get("value", ""))
        low, high = base.min_length, base.max_length
        if "length" in values:
            low = high = int(values["length"][0])
        low = int(values["minLength"][0]) if "minLength" in values else low
        high = int(values["maxLength"][0]) if "maxLength" in values else high
        if "enumeration" in values and base.base in ENUMERATED:
            sizes = [len(v) for v in values["enumeration"]]
            low, high = min(sizes), max(sizes)
        return SimpleType(base.base, low, high)

    def _content_base(self, part: _Part) -> SimpleType:
        """Type of the text of a complex type with simple content, down its chain of bases."""
        for content in part.node:
            if _local(content.tag) == "simpleContent":
                for derived in content:
                    inner = _Part(derived, part.prefixes, part.space)
                    if _local(derived.tag) == "restriction":
                        return self._restricted(inner)
                    if _local(derived.tag) == "extension":
                        return self.simple_named(derived.get("base"), inner)
        return SimpleType("string")

    # complex types

    def _attributes(self, part: _Part) -> list[Field]:
        """Of this type and its bases, bases first."""
        out: list[Field] = []
        for c in part.node:
            kind, inner = _local(c.tag), _Part(c, part.prefixes, part.space)
            if kind in ("simpleContent", "complexContent", "extension", "restriction"):
                if kind in ("extension", "restriction"):
                    base = self.find("type", c.get("base", "xs:anyType"), inner)
                    if base is not None and _local(base.node.tag) == "complexType":
                        out += self._attributes(base)
                out += self._attributes(inner)
            elif kind == "attributeGroup":
                out += self._attributes(self.find("attributeGroup", c.get("ref"), inner))
            elif kind == "attribute" and c.get("use") != "prohibited":
                target = self.find("attribute", c.get("ref"), inner) if c.get("ref") else inner
                node = target.node
                own = next((x for x in node if _local(x.tag) == "simpleType"), None)
                kind_ = self.simple(_Part(own, target.prefixes, target.space)) if own is not None else self.simple_named(node.get("type", "xs:string"), target)
                out.append(Field(node.get("name"), (0, 1), kind_, attribute=True))
        return list({f.name: f for f in out}.values())

    def _particles(self, part: _Part, above: list[tuple[str, int, int | None, int]]):
        """(element part, groups above it) in document order; a group is (kind, min, max, identity)."""
        for c in part.node:
            kind, inner = _local(c.tag), _Part(c, part.prefixes, part.space)
            low, high = int(c.get("minOccurs", 1)), (None if c.get("maxOccurs") == "unbounded" else int(c.get("maxOccurs", 1)))
            if kind in ("sequence", "choice", "all"):
                yield from self._particles(inner, [*above, (kind, low, high, id(c))])
            elif kind == "group":
                yield from self._particles(self.find("group", c.get("ref"), inner), [*above, ("group", low, high, id(c))])
            elif kind == "complexContent":
                yield from self._particles(inner, above)
            elif kind in ("extension", "restriction"):
                base = self.find("type", c.get("base", "xs:anyType"), inner)
                if kind == "extension" and base is not None and _local(base.node.tag) == "complexType":
                    yield from self._particles(base, above)
                yield from self._particles(inner, above)
            elif kind == "element":
                yield inner, [*above, ("element", low, high, id(c))]
            elif kind == "any":
                warnings.warn("xs:any is ignored", stacklevel=2)

    def _is_mixed(self, part: _Part) -> bool:
        node = part.node
        return node.get("mixed") in ("true", "1") or any(c.get("mixed") in ("true", "1") for c in node if _local(c.tag) == "complexContent")

    def _is_choice(self, part: _Part) -> bool:
        return next((_local(c.tag) == "choice" for c in part.node if _local(c.tag) in ("sequence", "choice", "all", "group")), False)

    def _table_name(self, name: str) -> str:
        n = self.tables.get(name, -1) + 1
        self.tables[name] = n
        return f"{name}_{n}" if n else name

    def element(self, part: _Part, path: tuple[int, ...]) -> tuple[str, SimpleType | ComplexType | None]:
        """Name and type of an element; None for a recursive type."""
        if part.node.get("ref"):
            part = self.find("element", part.node.get("ref"), part)
        name, node = part.node.get("name"), part.node
        inner = next((c for c in node if _local(c.tag) in ("complexType", "simpleType")), None)
        if inner is not None:
            kind = _Part(inner, part.prefixes, part.space)
        elif node.get("type"):
            kind = self.find("type", node.get("type"), part)
            if kind is None:
                return name, SimpleType(node.get("type").rpartition(":")[2])
        else:
            return name, SimpleType("string")
        if _local(kind.node.tag) == "simpleType":
            return name, self.simple(kind)
        return name, self.complex(kind, name, path)

    def complex(self, part: _Part, element: str, path: tuple[int, ...]) -> SimpleType | ComplexType | None:
        key = id(part.node)
        if key in path:
            return None
        if key in self.types:
            return self.types[key]
        attributes, content = self._attributes(part), None
        if any(_local(c.tag) == "simpleContent" for c in part.node):
            content = self._content_base(part)
            if not attributes:
                return content
        own = ComplexType(part.node.get("name") or element, self._table_name(element), choice=self._is_choice(part), mixed=self._is_mixed(part))
        fields: list[Field] = []
        for child, groups in self._particles(part, []):
            name, kind = self.element(child, (*path, key))
            if kind is None:
                warnings.warn(f"{own.name}.{name} is recursive and is dropped", stacklevel=2)
                continue
            choice = any(g[0] == "choice" for g in groups)
            highs = [g[2] for g in groups]
            occurs = (0 if choice else min(g[1] for g in groups), None if None in highs else max(highs))
            repeated = next((g[3] for g in reversed(groups[:-1]) if g[0] == "sequence" and g[2] != 1), None)
            same = next((f for f in fields if f.name == name and not f.attribute), None)
            if same is not None and same.type == kind:
                same.occurs = (min(same.occurs[0], occurs[0]), None if None in (same.occurs[1], occurs[1]) else max(same.occurs[1], occurs[1]))
                continue
            if same is not None:
                raise SchemaError(f"{own.name}: two fields {name} with different types")
            fields.append(Field(name, occurs, kind, group=repeated if groups[-1][2] == 1 else None))
        taken = {f.name for f in fields}
        for a in attributes:
            a.suffixed = a.name in taken
        if content is not None or own.mixed:
            fields.append(Field("value", (0, 1), content or SimpleType("string"), content=True))
        own.fields = attributes + fields
        self.types[key] = own
        return own

    def root(self, short_name: str = "DocumentRoot") -> ComplexType:
        """The type of the only global element, or a virtual type with all of them in name order."""
        if not self.order:
            raise SchemaError("the schema has no global element")
        fields = []
        for space, name in sorted(self.order, key=lambda x: x[1]):
            name, kind = self.element(self.parts["element", space, name], ())
            fields.append(Field(name, (1, 1), kind))
        if len(fields) == 1 and isinstance(fields[0].type, ComplexType):
            return fields[0].type
        return ComplexType(short_name, short_name, fields, virtual=True)
