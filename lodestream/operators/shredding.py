"""Nested records as flat tables, by columnar shredding.

shred() turns each record into one level sequence per leaf path of a schema: for every value, its repetition level
(at which repeated ancestor a new element began), its definition level (how much of the path is there) and the
value itself. assemble() rebuilds the table of any repeated ancestor from the sequences of the leaves it needs.

Every leaf below an ancestor has exactly one entry with a repetition level at or under the ancestor's for each
element (or for its absence), so counting those entries gives all leaves the same slot numbers, and slots link
children to parents without any join. Both steps are narrow: no shuffle, one Arrow batch at a time.

A schema is a StructType: an array of structs is a repeated group, a struct an optional one, anything else a leaf,
whose value is kept as text (numbers and booleans as JSON writes them, nested values as JSON).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Node:
    """A field of the schema: rep and def levels are those of an entry in which it is present."""

    name: str
    path: str
    repeated: bool
    rep: int
    defined: int
    children: list["Node"] = field(default_factory=list)
    parent: "Node | None" = None

    def leaves(self) -> list["Node"]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def tree(schema: T.StructType) -> Node:
    def build(name: str, kind: T.DataType, parent: Node | None) -> Node:
        repeated = isinstance(kind, T.ArrayType)
        inner = kind.elementType if repeated else kind
        path = name if parent is None or not parent.path else f"{parent.path}.{name}"
        node = Node(name, path, repeated, (parent.rep if parent else 0) + repeated, (parent.defined + 1) if parent else 0, [], parent)
        if isinstance(inner, T.StructType):
            node.children = [build(f.name, f.dataType, node) for f in inner.fields]
        return node

    return build("", schema, None)


def nested(shape: dict) -> T.StructType:
    """A schema from its shape: a dict is a group, a list of one dict a repeated group, anything else a leaf."""

    def kind(value) -> T.DataType:
        if isinstance(value, dict):
            return nested(value)
        if isinstance(value, list):
            return T.ArrayType(kind(value[0]))
        return T.StringType()

    return T.StructType([T.StructField(name, kind(value)) for name, value in shape.items()])


def text_of(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Shredder:
    """Level sequences of records, collected column by column."""

    def __init__(self, schema: T.StructType):
        self.root = tree(schema)
        self.columns: dict[str, tuple[list, list, list]] = {leaf.path: ([], [], []) for leaf in self.root.leaves()}
        self.nulls = {}  # per node: the columns below it

        def below(node: Node) -> None:
            self.nulls[node.path] = [self.columns[leaf.path] for leaf in node.leaves()]
            for child in node.children:
                below(child)

        below(self.root)

    def absent(self, node: Node, rep: int, defined: int) -> None:
        for reps, defs, values in self.nulls[node.path]:
            reps.append(rep)
            defs.append(defined)
            values.append(None)

    def add(self, record: dict) -> None:
        self.group(self.root, record, 0, 0)

    def group(self, node: Node, value: dict, rep: int, defined: int) -> None:
        for child in node.children:
            got = value.get(child.name)
            if got is None:
                self.absent(child, rep, defined)
            elif child.repeated:
                elements = got if isinstance(got, list) else [got]  # a lone element stands for a list of one
                if child.children:
                    elements = [e for e in elements if isinstance(e, dict)]
                if not elements:
                    self.absent(child, rep, defined)
                for i, element in enumerate(elements):
                    at = child.rep if i else rep
                    if child.children:
                        self.group(child, element, at, defined + 1)
                    else:
                        self.leaf(child, element, at, defined)
            elif child.children:
                if isinstance(got, dict):
                    self.group(child, got, rep, defined + 1)
                else:
                    self.absent(child, rep, defined)
            else:
                self.leaf(child, got, rep, defined)

    def leaf(self, node: Node, value, rep: int, defined: int) -> None:
        reps, defs, values = self.columns[node.path]
        reps.append(rep)
        defs.append(defined + (value is not None))
        values.append(None if value is None else text_of(value))


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


_PARSER = json.JSONDecoder(parse_constant=_no_number)


def parse_json(text: str | None):
    """The value of a complete JSON text, also where it stands in a JSON string; None for anything else, also for texts with
    NaN or Infinity."""
    value = text
    while isinstance(value, str):
        try:
            value = _PARSER.decode(value)
        except (ValueError, RecursionError):
            return None
    return value


def _texts(values: list[str | None]) -> pa.Array:
    """values as an Arrow column; halves of characters that stand alone, which JSON can escape, become the replacement character."""
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        whole = [v if v is None else v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for v in values]
        return pa.array(whole, pa.string())


def _level_type(schema: T.StructType) -> str:
    return "struct<" + ", ".join(f"`{leaf.path}`: struct<r: array<smallint>, d: array<smallint>, v: array<string>>" for leaf in tree(schema).leaves()) + ">"


def shred(
    records: DataFrame, payload: str, schema: T.StructType, records_of: Callable[[object], list[dict]] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """keep columns and levels, a struct with the level sequence of each leaf path; one row per record.

    records_of: gives the records of a parsed payload (by default the payload itself, if an object, or the objects
    of a list). Payloads that are null, empty, damaged or hold no record give no row. Unknown fields, whatever their
    names, are ignored; a value of another shape than the schema's counts as absent; a lone object where a list
    belongs counts as a list of one; JSON given as a string within JSON is parsed by records_of; an escaped half of a
    character that stands alone becomes the replacement character. To take several tables from one parse, write what
    shred() gives once (staged()) and assemble() each from it.
    """
    keep = keep or []
    picked = records.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{payload}`").cast("string").alias("_payload")).where("_payload IS NOT NULL")
    leaves = [leaf.path for leaf in tree(schema).leaves()]
    records_of = records_of or (lambda v: [v] if isinstance(v, dict) else [x for x in v if isinstance(x, dict)] if isinstance(v, list) else [])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                shredder, rows, ends = Shredder(schema), [], {p: [0] for p in leaves}
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for record in records_of(parse_json(text)):
                        shredder.add(record)
                        rows.append(i)
                        for p in leaves:
                            ends[p].append(len(shredder.columns[p][0]))
                structs = []
                for p in leaves:
                    reps, defs, values = shredder.columns[p]
                    ends_p = pa.array(ends[p], pa.int32())
                    columns = (pa.array(reps, pa.int16()), pa.array(defs, pa.int16()), _texts(values))
                    parts = [pa.ListArray.from_arrays(ends_p, x) for x in columns]
                    structs.append(pa.StructArray.from_arrays(parts, ["r", "d", "v"]))
                kept = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(len(keep))), pa.StructArray.from_arrays(structs, leaves)], names=[*keep, "levels"])

    kept_schema = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(over, f"{kept_schema + ', ' if keep else ''}levels {_level_type(schema)}")


def slots(reps: np.ndarray, level: int) -> np.ndarray:
    """For each entry, the number of the element (or absence) of that repetition level it belongs to."""
    return np.cumsum(reps <= level) - 1


def assemble(levels: DataFrame, schema: T.StructType, ancestor: str, leaves: list[str], keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """The table of a repeated ancestor: one row per element, with keep columns, leaves and positions.

    leaves: leaf paths of the ancestor or of those above it, named by their last two path parts joined by "_"
    (e.g. items_item_id). For each repeated group on the way stands <name>_no, the element's position within its
    parent, from 0. outer: elements above without elements below also give a row, with null leaves and position
    -1 below. Records without the outermost group give no row.
    """
    keep = keep or []
    root = tree(schema)
    by_path: dict[str, Node] = {}

    def index(node: Node) -> None:
        by_path[node.path] = node
        for child in node.children:
            index(child)

    index(root)
    if ancestor not in by_path or not by_path[ancestor].repeated:
        raise ValueError(f"{ancestor} is not a repeated group")
    target = by_path[ancestor]
    chain: list[Node] = []
    node = target
    while node is not None:
        if node.repeated:
            chain.insert(0, node)
        node = node.parent
    for p in leaves:
        if p not in by_path or by_path[p].children or not any(by_path[p].rep == g.rep and p.startswith(g.path + ".") for g in chain):
            raise ValueError(f"{p} is no leaf of {ancestor} or of a group above it")
    guide = next((p for p in leaves if by_path[p].rep == target.rep), None) or next(leaf.path for leaf in target.leaves() if leaf.rep == target.rep)
    needed = list(dict.fromkeys([guide, *leaves]))
    name_of = {p: "_".join(p.split(".")[-2:]) for p in leaves}
    deepest = [g.defined for g in chain]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {p: batch.column(len(keep) + i) for i, p in enumerate(needed)}

            def flat(p: str, part: str) -> pa.Array:
                return got[p].field(part).flatten()

            lists = got[guide].field("r")
            lengths = np.diff(lists.offsets.to_numpy())
            reps, defs = flat(guide, "r").to_numpy(), flat(guide, "d").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            wanted = np.flatnonzero(defs >= (chain[0].defined if outer else target.defined))
            columns = [batch.column(k).take(pa.array(row[wanted])) for k in range(len(keep))]
            for p in leaves:
                leaf = by_path[p]
                if p == guide:
                    columns.append(flat(p, "v").take(pa.array(wanted)))
                else:  # one entry per slot of the leaf's own level: slots are positions
                    at = slots(reps, leaf.rep)[wanted]
                    columns.append(flat(p, "v").take(pa.array(at)))
            for g, deep in zip(chain, deepest, strict=True):
                own = slots(reps, g.rep)
                starts = np.flatnonzero(reps <= g.rep - 1)  # entries that begin a new parent
                parent = slots(reps, g.rep - 1)
                number = own - own[starts][parent]
                number = np.where(defs >= deep, number, -1)
                columns.append(pa.array(number[wanted].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(name_of[p] for p in leaves), *(f"{g.name}_no" for g in chain)])

    out = ", ".join([*(f"`{c}` {levels.schema[c].dataType.simpleString()}" for c in keep), *(f"`{name_of[p]}` string" for p in leaves), *(f"`{g.name}_no` bigint" for g in chain)])
    return levels.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"levels.`{p}`").alias(f"_l{i}") for i, p in enumerate(needed))).mapInArrow(over, out)
