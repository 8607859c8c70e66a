"""Attributes of nested XML elements, by path, as fields of a struct.

Each task reads its texts with the standard library's parser. Texts that programs write differ in the values of their attributes and
little else, so a task parses each structure (what stands between values) once and finds the values of the next one by their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from operator import itemgetter
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are read between two Arrow batches, more or less.
_BATCH_BYTES = 4 << 20
#: Characters of structures that a task keeps at most; texts of others are parsed whole.
_KEPT_CHARACTERS = 32 << 20
#: Names of elements and attributes that a task keeps at most.
_KEPT_NAMES = 10_000
_CONTROLS = bytes(range(32))


@dataclass
class _Step:
    """What is read of an element: (attribute, place) of its own, steps below by element, (attribute, place) of named elements by name."""

    own: list[tuple[str, int]] = field(default_factory=list)
    below: dict[str, _Step] = field(default_factory=dict)
    named: dict[str, list[tuple[str, int]]] = field(default_factory=dict)


class Layout:
    """Fields `path_attribute` of an element. A path leads by the first element of each name; it is empty for the element itself.

    `named` gives a path, the names and the attributes of elements `tag` there that are told by their attribute `name`: fields
    `name_attribute`, of which the last element counts. `lists` gives elements right below of which all count: fields with their text
    or, where one is given, an attribute.
    """

    def __init__(self, attributes: dict[str, tuple[str, ...]], *, named: tuple[str, str, list[str], tuple[str, ...]] | None = None, lists: dict[str, str | None] | None = None) -> None:
        self.fields: list[str] = []
        self.lists, self.top, self.tag = lists or {}, _Step(), ""
        for path, names in attributes.items():
            self._at(path).own += [(n, self._place(f"{path}_{n}")) for n in names]
        if named:
            path, self.tag, keys, names = named
            self._at(path).named |= {k: [(n, self._place(f"{k}_{n}")) for n in names] for k in keys}
        self.read_of = {n for names in attributes.values() for n in names} | set(named[3] if named else ()) | {"name"} | {x for x in self.lists.values() if x}

    def _place(self, name: str) -> int:
        self.fields.append(name)
        return len(self.fields) - 1

    def _at(self, path: str) -> _Step:
        step = self.top
        for name in filter(None, path.split("/")):
            step = step.below.setdefault(name, _Step())
        return step

    def type(self, **more: T.DataType) -> T.StructType:
        kinds = [T.StructField(n, T.StringType()) for n in self.fields] + [T.StructField(n, T.ArrayType(T.StringType())) for n in self.lists]
        return T.StructType(kinds + [T.StructField(n, t) for n, t in more.items()])

    def read(self, element: Element, names: Names) -> list:
        """The values of all fields, lists last."""
        row: list = [None] * len(self.fields)
        self._fill(element, self.top, row, names)
        for tag, attribute in self.lists.items():
            row.append([names.of(x)(attribute) if attribute else x.text for x in element if names[x.tag] == tag])
        return row

    def _fill(self, element: Element, step: _Step, row: list, names: Names) -> None:
        if step.own:
            get = names.of(element)
            for name, i in step.own:
                row[i] = get(name)
        if step.below:
            left = dict(step.below)
            for x in element:
                found = left.pop(names[x.tag], None)  # the first of a name takes the step
                if found:
                    self._fill(x, found, row, names)
        if step.named:
            for x in element:
                if names[x.tag] == self.tag:
                    get = names.of(x)
                    for name, i in step.named.get(get("name"), ()):
                        row[i] = get(name)

    def arrays(self, rows: list[list]) -> list[pa.Array]:
        kinds = [pa.string()] * len(self.fields) + [pa.list_(pa.string())] * len(self.lists)
        return [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]

    def names(self) -> list[str]:
        return [*self.fields, *self.lists]


class Names(dict):
    """Names without their prefix, by names as they stand in a text."""

    def __init__(self, attributes: set[str]) -> None:
        super().__init__()
        self.attributes, self.seen, self.prefixed = attributes, {}, False

    def __missing__(self, name: str) -> str:
        short = self[name] = name.rpartition(":")[2]
        return short

    def of(self, element: Element) -> Callable[[str], str | None]:
        """What gives the attributes of an element by name."""
        return {self[k]: v for k, v in element.items()}.get if self.prefixed else element.get

    def tree(self, text: bytes | None) -> Element | None:
        """The root of a text; none where it isn't well-formed."""
        if len(self.seen) > _KEPT_NAMES:
            self.seen.clear()
            self.clear()
        made, known = TreeBuilder(), len(self.seen)
        parser = expat.ParserCreate("utf-8", None, self.seen)
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = made.start, made.end, made.data
        try:
            parser.Parse((text or b"").decode("utf-8", "replace"), True)
        except expat.ExpatError:
            return None
        if len(self.seen) > known:
            self.prefixed = any(":" in n and self[n] in self.attributes for n in self.seen)
        return made.close()


#: What picks single values of a part's pieces, and the places of each list's.
_Places = tuple[Callable[[list], Iterable], list[list[int]]]


@dataclass
class _Shape:
    """What a part of a structure holds: how many angle brackets and control characters, texts set in it, and places of the fields' values among its pieces."""

    angles: int
    controls: int
    fixed: list[str | None]
    root: _Places | None
    each: list[_Places]


class Reader:
    """Reads texts: the fields of the root and of each element `tag` right below it.

    A text is cut before such elements, and each part is split by quotes in structure and values. The structure of a part is parsed once,
    with marks for its values. It holds if the part is whole by itself and each mark is all of an attribute's value: then values without a quote,
    an angle bracket, a reference or a control character change nothing in what is parsed. Other texts are parsed as they are.
    """

    def __init__(self, root: Layout, tag: str, each: Layout) -> None:
        self.root, self.tag, self.each = root, tag, each
        self.names = Names(root.read_of | each.read_of)
        self.of_root = {*root.top.below, *root.lists, root.tag}
        self.head = re.compile(r"(?:<\?xml\s[^<>]*\?>)?\s*<([\w.:-]+)")
        self.cut = re.compile(rf"<((?:[\w.-]+:)?){tag}\b")
        self.shapes: dict[str, _Shape | None] = {}
        self.room = _KEPT_CHARACTERS

    def read(self, text: bytes | None) -> tuple[list | None, list[list]]:
        """The root's values and those of each element; no root where a text isn't well-formed."""
        plain = text and text.isascii() and b"&" not in text and b"<!" not in text
        found = self._by_shape(text) if plain else None
        if found:
            return found
        top = self.names.tree(text)
        return (None, []) if top is None else (self.root.read(top, self.names), self._below(top))

    def _below(self, top: Element) -> list[list]:
        return [self.each.read(x, self.names) for x in top if self.names[x.tag] == self.tag]

    def _by_shape(self, raw: bytes) -> tuple[list | None, list[list]] | None:
        """What a text holds, by the shapes of its parts; none where one doesn't hold."""
        text = raw.decode()
        head = self.head.match(text)
        if not head:
            return None
        cut = self.cut.search(text, head.end())
        parts = text[head.end() :].split(cut[0]) if cut else [text[head.end() :]]
        # Elements that are told by their name go by another quote, so that the name belongs to the structure.
        named = f'<{cut[1]}{self.each.tag} name="' if cut and self.each.tag else None
        root, below, angles, controls = None, [], 0, 0
        for i, part in enumerate(parts):
            if named:
                part = f"{named[:-1]}'".join([x.replace('"', "'", 1) if at else x for at, x in enumerate(part.split(named))])
            pieces = part.split('"')
            if len(pieces) % 2 == 0:
                return None
            before, last = cut[0] if i else head[0], i == len(parts) - 1
            structure = '"'.join(pieces[::2])
            key = f"{i > 0:d}{last:d}{head[1]} {before}{structure}"
            shape = self.shapes.get(key, self)
            if shape is self:
                self.room -= len(key)
                if self.room < 0:
                    self.shapes.clear()
                    self.room = _KEPT_CHARACTERS - len(key)
                shape = self.shapes[key] = self._shape(head[1], before, pieces, i == 0, last)
            if not shape:
                return None
            angles, controls = angles + shape.angles, controls + shape.controls
            pieces += shape.fixed
            if shape.root:
                root = _values(shape.root, pieces)
            below += [_values(x, pieces) for x in shape.each]
        if angles != text.count("<") or controls != len(raw) - len(raw.translate(None, _CONTROLS)):
            return None
        return root, below

    def _shape(self, name: str, before: str, pieces: list[str], first: bool, last: bool) -> _Shape | None:
        """The shape of a part in a root of that name; none where it doesn't hold."""
        marks = {f"\ue000{i}\ue001": i for i in range(1, len(pieces), 2)}
        part = before + pieces[0] + "".join(f'"{m}"{x}' for m, x in zip(marks, pieces[2::2], strict=False))
        top = self.names.tree(f"{'' if first else f'<{name}>'}{part}{'' if last else f'</{name}>'}".encode())
        if top is None or not marks.keys() <= {v for x in top.iter() for v in x.attrib.values()}:
            return None
        if not first and any(self.names[x.tag] in self.of_root for x in top):
            return None
        if any(self.names[x.tag] in (self.root.tag, self.each.tag) and self.names.of(x)("name") in marks for x in top.iter()):
            return None
        fixed: list[str | None] = []

        def place(value: str | None) -> int:
            if value not in marks:
                fixed.append(value)
            return marks[value] if value in marks else len(pieces) + len(fixed) - 1

        def places(row: list) -> _Places:
            single = [place(x) for x in row if not isinstance(x, list)]
            return itemgetter(*single) if len(single) > 1 else lambda x: [x[i] for i in single], [[place(y) for y in x] for x in row if isinstance(x, list)]

        structure = (before + "".join(pieces[::2])).encode()
        return _Shape(structure.count(b"<"), len(structure) - len(structure.translate(None, _CONTROLS)), fixed, places(self.root.read(top, self.names)) if first else None, [places(x) for x in self._below(top)])


def _values(places: _Places, pieces: list[str | None]) -> list:
    return [*places[0](pieces), *([pieces[i] for i in x] for x in places[1])]


def _structs(layout: Layout, rows: list[list], mask: pa.Array | None = None, **more: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([*layout.arrays(rows), *more.values()], names=[*layout.names(), *more], mask=mask)


def parsed(texts: DataFrame, text_col: str, root: Layout, tag: str, each: Layout) -> DataFrame:
    """The other columns beside a text and `r`: the fields of the root and, as an array by the name of `tag`, those of each such element right below it; null where a text isn't well-formed."""
    kept = [c for c in texts.columns if c != text_col]
    schema = T.StructType([*texts.select(*kept).schema, T.StructField("r", root.type(**{tag: T.ArrayType(each.type())}))])

    def structs(reader: Reader, values: list[bytes | None]) -> pa.StructArray:
        none = [None] * len(root.fields) + [[]] * len(root.lists)
        read = [reader.read(x) for x in values]
        ends = pa.array(accumulate((len(x) for _, x in read), initial=0), pa.int32())
        lists = pa.ListArray.from_arrays(ends, _structs(each, [x for _, found in read for x in found]))
        return _structs(root, [x or none for x, _ in read], pa.array([x is None for x, _ in read]), **{tag: lists})

    def from_xml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, tag, each)
        for batch in batches:
            step = max(1, batch.num_rows * _BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], structs(reader, part.column(text_col).to_pylist())], names=[*kept, "r"])

    return texts.withColumn(text_col, F.col(text_col).cast("binary")).mapInArrow(from_xml, schema)
