"""Problem 2: deeply nested semi-structured records as related flat tables.

Method: columnar shredding.  Every record is striped into columns, one per place and
kind of value, each a sequence of (repetition level, definition level, value).  The
repetition level of an entry names the list that goes on with it (0: a new record),
the definition level how much of the path is there.  Flat tables, and records again,
are put together from the level sequences alone.

A place is named by its fields, joined by ``.``, with ``[]`` for the elements of a
list.  Each place has a column for every kind of value that stands there: ``media[]``
for single values (null is one), ``media[]{}`` for objects, ``media[]#`` for lists.
With ``full`` steps in its path, an entry of definition level ``full + 1`` says that
there is a value of the column's kind, one of ``full`` that there is another one, and
any lower one where the path breaks off.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIPES = "record_id long, column string, rep array<int>, def array<int>, value array<string>"
_STRIPES = pa.schema([("record_id", pa.int64()), ("column", pa.string()), ("rep", pa.list_(pa.int32())), ("def", pa.list_(pa.int32())), ("value", pa.list_(pa.string()))])
_ABSENT = object()
#: Records whose rows are held before they are passed on.
HELD = 2000

Columns = dict[str, tuple[list[int], list[int], list]]


_MARKS = "~.[]{#"


@lru_cache(maxsize=10_000)
def _escaped(name: str) -> str:
    """A field name without the characters that columns are named with."""
    for i, ch in enumerate(_MARKS):
        name = name.replace(ch, f"~{i}")
    return name or "~"


@lru_cache(maxsize=10_000)
def _plain(name: str) -> str:
    if name == "~":
        return ""
    for i, ch in reversed(list(enumerate(_MARKS))):
        name = name.replace(f"~{i}", ch)
    return name


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class _Place:
    """A place in the tree of a record's paths, with the kinds of value it holds."""

    __slots__ = ("name", "fields", "item", "single")

    def __init__(self, name: str):
        self.name = name
        self.fields: dict[str, _Place] | None = None
        self.item: _Place | None = None
        self.single = False

    def field(self, name: str) -> _Place:
        place = self.fields.get(name)
        if place is None:
            place = self.fields[name] = _Place(f"{self.name}.{_escaped(name)}" if self.name else _escaped(name))
        return place


class Shredder:
    """Stripes one record after another.

    ``arrays`` are the fields that hold lists in principle: a lone object in one
    counts as its only element, a JSON text of an array or object as what it says.
    Any other list is repeated too.
    """

    def __init__(self, arrays: Iterable[str]):
        self.arrays = frozenset(arrays)

    def _as_held(self, value):
        if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
            try:
                decoded = json.loads(value)
            except ValueError:
                return value
            if isinstance(decoded, (dict, list)):
                value = decoded
        return [value] if isinstance(value, dict) else value

    def as_counted(self, value, place: _Place | None = None):
        """The value with its fields as they count, and in ``place`` the tree of its paths."""
        place = place or _Place("")
        if isinstance(value, dict):
            if place.fields is None:
                place.fields = {}
            return {k: self.as_counted(self._as_held(v) if k in self.arrays else v, place.field(k)) for k, v in value.items()}
        if isinstance(value, list):
            if place.item is None:
                place.item = _Place(place.name + "[]")
            return [self.as_counted(v, place.item) for v in value]
        place.single = True
        return value

    def stripes(self, record) -> Columns:
        """Columns of one record, with its values as they are; what a record lacks altogether has no column."""
        if not isinstance(record, dict):
            return {}
        root, columns = _Place(""), {}
        record = self.as_counted(record, root)
        self._write(columns, root, record, 0, 0, 0)
        return columns

    def _write(self, columns: Columns, place: _Place, value, rep: int, level: int, depth: int) -> None:
        """All columns at and below ``place`` for one value, or for its absence."""
        is_object, is_list = isinstance(value, dict), isinstance(value, list)
        if place.single:
            column = columns.get(place.name) or columns.setdefault(place.name, ([], [], []))
            there = not is_object and not is_list and value is not _ABSENT
            column[0].append(rep)
            column[1].append(level + there)
            column[2].append(value if there else None)
        if place.fields is not None:
            name = place.name + "{}"
            column = columns.get(name) or columns.setdefault(name, ([], [], []))
            column[0].append(rep)
            column[1].append(level + is_object)
            for field, below in place.fields.items():
                held = value.get(field, _ABSENT) if is_object else _ABSENT
                self._write(columns, below, held, rep, level + (held is not _ABSENT), depth)
        if place.item is not None:
            name = place.name + "#"
            column = columns.get(name) or columns.setdefault(name, ([], [], []))
            column[0].append(rep)
            column[1].append(level + is_list)
            if is_list and value:
                for i, item in enumerate(value):
                    self._write(columns, place.item, item, depth + 1 if i else rep, level + 1, depth + 1)
            else:
                self._write(columns, place.item, _ABSENT, rep, level, depth + 1)


def _place_of(column: str) -> tuple[str, str]:
    """A column's place and kind (``{}``, ``#`` or none)."""
    return (column[:-2], "{}") if column.endswith("{}") else (column[:-1], "#") if column.endswith("#") else (column, "")


@lru_cache(maxsize=10_000)
def _steps(place: str) -> tuple[str | None, ...]:
    """The fields of a place in order, None for an element of a list."""
    out: list[str | None] = []
    for piece in place.split(".") if place else ():
        bare = piece.rstrip("[]")
        out.append(_plain(bare))
        out += [None] * ((len(piece) - len(bare)) // 2)
    return tuple(out)


def indexes(rep: list[int], depth: int) -> Iterator[list[int]]:
    """Positions in the ``depth`` lists around every entry, from its repetition levels."""
    at = [0] * depth
    for r in rep:
        if r:
            at[r - 1] += 1
        for i in range(r, depth):
            at[i] = 0
        yield at


def assemble(columns: Mapping[str, tuple[list[int], list[int], list]]):
    """The record of the given columns (as it counts), from their levels and values alone."""
    parts = []
    for column, (rep, level, value) in columns.items():
        place, kind = _place_of(column)
        steps = _steps(place)
        for n, at in enumerate(indexes(rep, steps.count(None))):
            if level[n] == len(steps) + 1:
                number = iter(at)
                path = [next(number) if s is None else s for s in steps]
                parts.append((len(path), path, {} if kind == "{}" else [] if kind == "#" else value[n]))
    root: dict = {}
    # Shorter paths first, and elements of a list in order, so that what holds a value is there before it.
    for size, path, value in sorted(parts, key=lambda p: (p[0], [s for s in p[1] if isinstance(s, int)])):
        if not size:
            continue
        held = root
        for step in path[:-1]:
            held = held[step]
        if isinstance(held, list):
            held.append(value)
        else:
            held[path[-1]] = value
    return root


def _records(part: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    for record_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        try:
            record = json.loads(text)
        except (ValueError, RecursionError):
            continue
        if isinstance(record, dict):
            yield record_id, record


def _shredded(df: DataFrame, id_col: str, json_col: str, arrays: Iterable[str], rows_of: Callable[[int, Columns], Iterable[tuple]], schema: pa.Schema, sql: str) -> DataFrame:
    """Every record shredded, and the rows that ``rows_of`` makes of its columns."""
    names = tuple(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder(names)
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                out: list[tuple] = []
                for record_id, record in _records(batch.slice(at, HELD)):
                    try:
                        columns = shredder.stripes(record)
                    except RecursionError:
                        continue
                    out += rows_of(record_id, columns)
                held = zip(*out) if out else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema)], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(json_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, sql)


def shred(df: DataFrame, id_col: str, json_col: str, arrays: Iterable[str]) -> DataFrame:
    """``record_id, column, rep, def, value``: the stripes of every record, one row per record and column.

    Values are JSON; columns of objects and lists have none.  A null, unreadable or
    other than object-valued record has no stripes, nor has one that is nested too
    deep for the JSON reader (about a thousand levels).  Repeated rows are shredded as
    often as they come.  No row is moved.
    """

    def rows_of(record_id: int, columns: Columns) -> Iterator[tuple]:
        for column, (rep, level, value) in columns.items():
            full = len(_steps(_place_of(column)[0])) + 1 if value else 0
            yield record_id, column, rep, level, [json.dumps(v, ensure_ascii=False) if d == full else None for v, d in zip(value, level)] if value else None

    return _shredded(df, id_col, json_col, arrays, rows_of, _STRIPES, STRIPES)


def rebuild(stripes: DataFrame) -> DataFrame:
    """``record_id, payload_json``: the records of stripes, as they count; ids must be unique.

    A record's stripes are brought together by its id, which is all that is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for held in batch.column("held").to_pylist():
                columns = {c["column"]: (c["rep"], c["def"], [None if v is None else json.loads(v) for v in c["value"] or ()]) for c in held}
                texts.append(json.dumps(assemble(columns), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(texts, pa.string())], ["record_id", "payload_json"])

    held = stripes.groupBy("record_id").agg(F.collect_list(F.struct("column", "rep", "def", "value")).alias("held"))
    return held.mapInArrow(run, "record_id long, payload_json string")


class _Path:
    """A place in a list: where the positions go, and where the nearest enclosing case ends."""

    def __init__(self, place: str, arrays: frozenset[str]):
        self.pieces = [_plain(p) for p in place.split("[]")[:-1]]
        self.full = len(_steps(place)) + 1
        self.depth = len(self.pieces)
        # Levels whose list is one of the fields in question; a list in a list belongs to none.
        self.cases = [i for i, p in enumerate(place.split("[]")[:-1]) if p and _plain(p.rsplit(".", 1)[-1]) in arrays]
        self.is_case = bool(self.cases) and self.cases[-1] == self.depth - 1
        self.parent = self.cases[-2] if len(self.cases) > 1 else None
        if not self.is_case:
            # An element that goes on with a list is an array, and no row.
            self.parent = max((i for i in self.cases if i < self.depth - 1 and self.pieces[i + 1]), default=None)

    def names(self, at: list[int]) -> tuple[str, str]:
        out, parent = "$.", "$"
        for i, piece in enumerate(self.pieces):
            out += f"{piece}[{at[i]}]"
            if i == self.parent:
                parent = out
        return parent, out


class _Paths(dict):
    def __init__(self, arrays: Iterable[str]):
        super().__init__()
        self.arrays = frozenset(arrays)

    def __missing__(self, place: str) -> _Path:
        path = self[place] = _Path(place, self.arrays)
        return path


_OBJECTS = pa.schema([("record_id", pa.int64()), ("parent_path", pa.string()), ("path", pa.string())])
_OBJECTS_SQL = "record_id long, parent_path string, path string"


def _cases(record_id: int, column: str, rep: list[int], level: list[int], paths: _Paths) -> Iterator[tuple]:
    """Rows of the objects that a column of objects in one of the arrays tells of."""
    path = paths[column[:-2]]
    if path.is_case:
        for at, n in zip(indexes(rep, path.depth), level):
            if n == path.full:
                yield record_id, *path.names(at)


def objects(stripes: DataFrame, arrays: Iterable[str]) -> DataFrame:
    """``record_id, parent_path, path``: every object that is an element of one of ``arrays``, from the levels in stripes."""
    names = tuple(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _Paths(names)
        for batch in batches:
            out: list[tuple] = []
            for record_id, column, rep, level in zip(*(batch.column(c).to_pylist() for c in ("record_id", "column", "rep", "def"))):
                out += _cases(record_id, column, rep, level, paths)
            held = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, _OBJECTS)], schema=_OBJECTS)

    lists = stripes.filter(F.col("column").endswith("[]{}")).select("record_id", "column", "rep", "def")
    return lists.mapInArrow(run, _OBJECTS_SQL)


def nested_objects(df: DataFrame, id_col: str, json_col: str, arrays: Iterable[str]) -> DataFrame:
    """The same in one pass: records are shredded into all their columns and the rows taken from the levels at once."""
    names = tuple(arrays)
    paths = _Paths(names)

    def rows_of(record_id: int, columns: Columns) -> Iterator[tuple]:
        for column, (rep, level, _) in columns.items():
            if column.endswith("[]{}"):
                yield from _cases(record_id, column, rep, level, paths)

    return _shredded(df, id_col, json_col, names, rows_of, _OBJECTS, _OBJECTS_SQL)


_TABLES = pa.schema([("record_id", pa.int64()), ("table", pa.string()), ("parent_path", pa.string()), ("path", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
_TABLES_SQL = "record_id long, table string, parent_path string, path string, fields map<string,string>"


def flat_tables(df: DataFrame, id_col: str, json_col: str, arrays: Iterable[str]) -> DataFrame:
    """``record_id, table, parent_path, path, fields``: one row per record, per object in a list, and per other element of one.

    A record is a row of table ``$`` with path ``$`` and no parent.  An object in any
    list is a row of the table its place names.  A single value (null is one) in a list
    is a row of the table named like the place and ``.value``, with the field ``value``.
    ``fields`` maps the single values of the object (of plain objects in it too, by
    dotted name) to their text; what is absent is no key, what is null has a null.
    ``parent_path`` is the path of the nearest enclosing object in one of ``arrays``,
    ``$`` at the top.  :func:`typed` makes one of the tables of it.
    """
    names = tuple(arrays)
    paths = _Paths(names)

    def rows_of(record_id: int, columns: Columns) -> Iterator[tuple]:
        # Columns of single values by the object they hang from.
        leaves: dict[str, list[tuple[str, list, list, int]]] = {}
        for column, (_, level, value) in columns.items():
            if value and not column.endswith("[]"):
                owner, _, field = column.rpartition("[].")
                leaves.setdefault(owner and owner + "[]", []).append((_plain(field), level, value, len(_steps(column)) + 1))
        yield record_id, "$", None, "$", [(f, _text(v[0])) for f, lv, v, full in leaves.get("", ()) if lv[0] == full]
        for column, (rep, level, value) in columns.items():
            place, kind = _place_of(column)
            if not place.endswith("[]") or kind == "#":
                continue
            path = paths[place]
            for n, at in enumerate(indexes(rep, path.depth)):
                if level[n] == path.full:
                    if kind:
                        table, fields = place, [(f, _text(v[n])) for f, lv, v, full in leaves.get(place, ()) if lv[n] == full]
                    else:
                        table, fields = place + ".value", [("value", _text(value[n]))]
                    yield record_id, table, *path.names(at), fields

    return _shredded(df, id_col, json_col, names, rows_of, _TABLES, _TABLES_SQL)


def typed(flat: DataFrame, name: str, fields: Mapping[str, str]) -> DataFrame:
    """The table ``name`` of :func:`flat_tables`: ``record_id, parent_path, path`` and a column of its type for each of ``fields``.

    A value that is not of the type is null.  The key is ``(record_id, path)``, and
    ``(record_id, parent_path)`` the parent's.
    """
    columns = [F.col("fields").getItem(f).try_cast(kind).alias(f) for f, kind in fields.items()]
    return flat.filter(F.col("table") == name).select("record_id", "parent_path", "path", *columns)


def write_tables(flat: DataFrame, path: str) -> None:
    """All tables of :func:`flat_tables` as Parquet, one folder each; written in one pass, no row is moved."""
    flat.write.mode("overwrite").partitionBy("table").parquet(path)
