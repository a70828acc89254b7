"""A database sink that leaves each key once: staged rows, one commit, and a fence of batches.

Tasks write to a staging table, under a token of their own attempt. When all are done, one transaction moves the rows of the attempts that
count into the target, where a row whose key is there replaces it, and notes the batch. A batch that was noted before changes
nothing, so a replayed one is harmless; rows of failed and of doubled attempts have other tokens and are thrown away.

The database is a plug-in's matter: connect() gives a DB-API connection to one that knows INSERT ... ON CONFLICT.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that go to the database at once.
ROWS = 500


@dataclass
class Staged(WriterCommitMessage):
    token: str
    rows: int


def _name(x: str) -> str:
    if not x.replace("_", "a").isalnum():
        raise ValueError(f"no name of a table or column: {x!r}")
    return x


class _Writer(DataSourceWriter):
    def __init__(self, connect: Callable, options: dict, schema: StructType, mark: str):
        self.connect, self.mark = connect, mark
        self.table, self.keys, self.batch = _name(options["table"]), [_name(k.strip()) for k in options["key"].split(",")], options["batch"]
        self.columns = [_name(c) for c in schema.names]
        self.stage, self.fence = f"{self.table}_staged", f"{self.table}_batches"

    def write(self, iterator: Iterator[Row]) -> Staged:
        token, n, some = uuid.uuid4().hex, 0, []
        sql = f"INSERT INTO {self.stage} ({', '.join(self.columns)}, staged_job, staged_token, staged_at) VALUES ({', '.join([self.mark] * (len(self.columns) + 3))})"
        db = self.connect()
        try:
            for row in iterator:
                n += 1
                some.append((*row, self.batch, token, n))
                if len(some) == ROWS:
                    db.cursor().executemany(sql, some)
                    some = []
            if some:
                db.cursor().executemany(sql, some)
            db.commit()
        finally:
            db.close()
        return Staged(token, n)

    def _clear(self, db) -> None:
        db.cursor().execute(f"DELETE FROM {self.stage} WHERE staged_job = {self.mark}", (self.batch,))

    def commit(self, messages: list[Staged | None]) -> None:
        columns, keys, m = ", ".join(self.columns), ", ".join(self.keys), self.mark
        rest = [c for c in self.columns if c not in self.keys]
        change = f"DO UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in rest)}" if rest else "DO NOTHING"
        db = self.connect()
        try:
            at = db.cursor()
            # the fence comes first: of two writers of a batch the second waits here, and then finds it noted
            at.execute(f"INSERT INTO {self.fence} (batch) VALUES ({m}) ON CONFLICT (batch) DO NOTHING", (self.batch,))
            if at.rowcount:
                for x in messages:
                    at.execute(f"INSERT INTO {self.table} ({columns}) SELECT {columns} FROM {self.stage} WHERE staged_token = {m} ORDER BY staged_at ON CONFLICT ({keys}) {change}", (x.token,))
            self._clear(db)
            db.commit()
        except BaseException:
            db.rollback()
            raise
        finally:
            db.close()

    def abort(self, messages: list[Staged | None]) -> None:
        with contextlib.closing(self.connect()) as db:
            self._clear(db)
            db.commit()


def prepare(connect: Callable, table: str, columns: dict[str, str], key: list[str]) -> None:
    """The target, its staging table and its fence, where they are not there. columns: names and the database's types."""
    listed = ", ".join(f"{_name(c)} {t}" for c, t in columns.items())
    with contextlib.closing(connect()) as db:
        at = db.cursor()
        at.execute(f"CREATE TABLE IF NOT EXISTS {_name(table)} ({listed}, PRIMARY KEY ({', '.join(map(_name, key))}))")
        at.execute(f"CREATE TABLE IF NOT EXISTS {table}_staged ({listed}, staged_job TEXT, staged_token TEXT, staged_at BIGINT)")
        at.execute(f"CREATE TABLE IF NOT EXISTS {table}_batches (batch TEXT PRIMARY KEY)")
        db.commit()


def upsert(rows: DataFrame, connect: Callable, table: str, key: list[str], batch: str, mark: str = "?") -> None:
    """Rows into a table made by prepare(), each key once: a row that is there is replaced. Rows that share a key must be equal, or which of them
    stays is not said; a null key is an error. batch: what a replay of the same rows has in common. mark: how the
    driver writes a parameter. Partitions of one key are not split, so that rows meet in one task's order."""

    class Upsert(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paperloom_upsert"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(connect, dict(self.options), schema, mark)

    checked = rows.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(F.lit(f"a null in the key column {k}"))) for k in key})
    rows.sparkSession.dataSource.register(Upsert)
    checked.repartition(*key).write.format("paperloom_upsert").mode("append").option("table", table).option("key", ",".join(key)).option("batch", batch).save()
