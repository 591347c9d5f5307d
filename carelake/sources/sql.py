"""Resources in SQL databases: JDBC tables, and SQLite files in a folder.

A JDBC table is read in ranges of a whole-numbered column and written in batches by
all executors; its driver (PostgreSQL's, for one) must be on the class path. SQLite
files have no server: a folder holds one for each partition, written whole under a
temporary name and renamed, and read as binary files, so any file system that
Spark and Arrow know will do.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows that are sent to a database, or fetched from it, at once.
BATCH = 10_000


def jdbc_options(url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **more: str) -> dict[str, str]:
    """Options of a JDBC read: one query for each range of the column."""
    out = {"url": url, "dbtable": table, "fetchsize": str(BATCH), "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true", **more}
    if column and bounds:
        out |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 16, **more: str) -> DataFrame:
    """A table, in ranges of the column between its least and greatest value, which are asked for first."""
    bounds = None
    if column:
        asked = f"(SELECT min({column}) AS a, max({column}) AS b FROM {table}) AS bounds"
        low, high = spark.read.format("jdbc").options(**jdbc_options(url, asked, **more)).load().first()
        bounds = (int(low), int(high)) if low is not None else None
    return spark.read.format("jdbc").options(**jdbc_options(url, table, column, bounds, parts, **more)).load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", parts: int = 16, **more: str) -> None:
    """Appends to (or replaces the rows of) a table over at most parts connections."""
    options = {"url": url, "dbtable": table, "batchsize": str(BATCH), "isolationLevel": "READ_COMMITTED", **({"truncate": "true"} if mode == "overwrite" else {}), **more}
    rows.coalesce(parts).write.format("jdbc").options(**options).mode(mode).save()


def _sql_type(t: DataType) -> str:
    return {"string": "TEXT", "double": "REAL", "float": "REAL", "binary": "BLOB"}.get(t.simpleString(), "INTEGER" if t.simpleString() in ("bigint", "int", "smallint", "tinyint", "boolean") else "")


def _columns(schema: StructType) -> str:
    kinds = [(f.name, _sql_type(f.dataType)) for f in schema]
    bad = [n for n, k in kinds if not k]
    if bad:
        raise ValueError(f"SQLite has no column for {', '.join(bad)}")
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    return ", ".join(f"{quoted(n)} {k}" for n, k in kinds)


def write_sqlite(rows: DataFrame, path: str, table: str = "resources") -> int:
    """Writes a folder of SQLite files, one for each partition that has rows, and returns how many rows they hold."""
    columns, marks, written = _columns(rows.schema), ", ".join("?" * len(rows.columns)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        n = 0
        with tempfile.TemporaryDirectory() as local:  # of this task alone; what it holds is moved to the shared folder
            name = os.path.join(local, "part.sqlite")
            db = sqlite3.connect(name)
            db.execute(f'CREATE TABLE "{table}" ({columns})')
            for b in batches:
                db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', zip(*(c.to_pylist() for c in b.columns)))
                n += b.num_rows
            db.commit()
            db.close()
            if n:
                where, base = fs.FileSystem.from_uri(path)
                where.create_dir(base, recursive=True)
                # a task that runs again writes under the same name
                key, making = f"part-{written}-{TaskContext.get().partitionId():06d}.sqlite", f"{base}/_making-{uuid.uuid4().hex}"
                with open(name, "rb") as f, where.open_output_stream(making) as out:
                    while piece := f.read(1 << 20):
                        out.write(piece)
                where.move(making, f"{base}/{key}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_sqlite(spark: SparkSession, path: str, schema: str | StructType, table: str = "resources") -> DataFrame:
    """The rows of a table in all SQLite files of a folder; a task holds one file's bytes at a time."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in shape)
    kinds = [f.dataType.simpleString() for f in shape]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                db = sqlite3.connect(":memory:")
                db.deserialize(data.as_py())
                cursor = db.execute(f'SELECT {names} FROM "{table}"')
                while got := cursor.fetchmany(BATCH):
                    columns = [pa.array([None if v is None else bool(v) for v in c] if k == "boolean" else c, arrow[k]) for c, k in zip(zip(*got), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in shape])
                db.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sqlite").load(path).select("content")
    return files.mapInArrow(run, shape)
