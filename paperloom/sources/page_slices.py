"""Pages of container files as a data source whose partitions are slices of a file's pages.

What a file holds is a plug-in's matter (see Extractor); no PDF library is part of this package. A file of many
pages is read by many tasks, each of which opens it for itself and reads its pages only. Filters on path and page_no leave out files and
slices; a schema without text asks the plug-in for none.

    spark.dataSource.register(page_source(MyExtractor()))
    spark.read.format("page_slices").option("path", "/data/*.pdf").load().where("page_no <= 10")

Files are opened by Python, where pyarrow knows their file system. For stores that only Spark reads there is
store.read_pdf_pages, whose tasks take whole files.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGES = "path string, page_no int, text string, width double, height double, warning string"


class Extractor(Protocol):
    """What reads a kind of file. Both get the open file, in which they may seek."""

    def count(self, file: BinaryIO) -> int:
        """How many pages it has."""

    def pages(self, file: BinaryIO, first: int, last: int, text: bool) -> Iterable[tuple[str | None, float, float]]:
        """(text, width, height) of pages first to last, from 1 and both included; text may be null where none is asked for."""


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__(None)


class _Reader(DataSourceReader):
    def __init__(self, extractor: Extractor, options: dict, schema: StructType):
        self.extractor, self.columns = extractor, schema.names
        self.where, self.size = options["path"], int(options.get("slice", "20"))
        if self.size < 1:
            raise ValueError("a slice has one page at least")
        self.low, self.high, self.numbers, self.paths = 1, 2**31 - 1, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds that slices and files are chosen by. Spark applies all filters again to the rows, of which a slice may have too many."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("page_no",) and isinstance(f, In):
                self.numbers = set(f.value) if self.numbers is None else self.numbers & set(f.value)
            elif column == ("page_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
            yield f

    def _files(self):
        from pyarrow import fs

        folder, _, pattern = self.where.rpartition("/")
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder or ".")
        found = system.get_file_info(fs.FileSelector(root))
        return system, sorted(x.path for x in found if x.is_file and fnmatch.fnmatch(x.base_name, pattern))

    def partitions(self) -> list[Slice]:
        system, paths = self._files()
        out = []
        for path in paths:
            if self.paths is not None and path not in self.paths:
                continue
            with system.open_input_file(path) as file:
                n = self.extractor.count(file)
            for first in range(1, n + 1, self.size):
                last = min(n, first + self.size - 1)
                if last >= self.low and first <= self.high and (self.numbers is None or any(first <= x <= last for x in self.numbers)):
                    out.append(Slice(path, max(first, self.low), min(last, self.high)))
        return out or [Slice("", 1, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.last < part.first:
            return
        system, _ = self._files()
        text = bool({"text", "warning"} & set(self.columns))
        kinds = {"path": pa.string(), "page_no": pa.int32(), "text": pa.string(), "width": pa.float64(), "height": pa.float64(), "warning": pa.string()}
        with system.open_input_file(part.path) as file:
            for number, (t, width, height) in enumerate(self.extractor.pages(file, part.first, part.last, text), part.first):
                warning = f"page {number}: no extractable text" if text and not (t or "").strip() else None
                row = {"path": part.path, "page_no": number, "text": t, "width": width, "height": height, "warning": warning}
                yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], kinds[c]) for c in self.columns})


def page_source(extractor: Extractor, name: str = "page_slices") -> type[DataSource]:
    """The data source of an extractor's files, to be registered. Options: path, whose last part may have * and ?; slice, pages of a partition."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(extractor, dict(self.options), schema)

    return Pages


def register(spark: SparkSession, extractor: Extractor, name: str = "page_slices") -> None:
    """Makes the source known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(extractor, name))
