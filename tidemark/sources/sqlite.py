"""SQLite tables as a Spark data source, read in parallel by ranges of the row number, and written to.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite").option("path", file).option("table", "posts_raw").load()

Options: ``path``, ``table``, ``columns`` (separated by commas; all if absent),
``limit``, ``partitions`` (8 if absent).  The file must be in a folder that all
executors see; it is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _type(declared: str):
    """Spark's type by SQLite's rules of column affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if "CHAR" in d or "CLOB" in d or "TEXT" in d:
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    if "REAL" in d or "FLOA" in d or "DOUB" in d:
        return DoubleType()
    return StringType()


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            info = c.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        kinds = {name: _type(declared) for _, name, declared, *_ in info}
        wanted = [x.strip() for x in self.options.get("columns", "").split(",") if x.strip()] or list(kinds)
        if missing := sorted(set(wanted) - set(kinds)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return StructType([StructField(n, kinds[n]) for n in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SQLiteReader(schema, dict(self.options))


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Rows]:
        with _open(self.options["path"]) as c:
            lo, hi = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.options['table'])}").fetchone()
        if lo is None:
            return [Rows(0, -1)]
        # A limit is the feature of a smoke run; it is taken from one range.
        n = 1 if "limit" in self.options else max(1, int(self.options.get("partitions", 8)))
        step = -(-(hi - lo + 1) // n)
        return [Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        sql = f"select {columns} from {_quoted(self.options['table'])} where rowid between ? and ?"
        if "limit" in self.options:
            sql += f" limit {int(self.options['limit'])}"
        kinds = [type(f.dataType) for f in self.schema.fields]
        with _open(self.options["path"]) as c:
            for row in c.execute(sql, (partition.first, partition.last)):
                # SQLite may hold any type in any column.
                yield tuple(str(v) if k is StringType and v is not None and not isinstance(v, str) else v for k, v in zip(kinds, row))
