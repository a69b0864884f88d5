"""Web pages as a Spark data source: ``spark.read.format("lensmark_pages")``.

Options: path, Parquet files or a folder of them with a column url; fetch, ``module:function`` from a url to a page's HTML, asked in tasks; without it the files' own column html is
the page, as in an archive. A task reads a row group of a file. Filters of url (=, IN) are taken over: pages that they leave out are not fetched. A page that fails has
an error and no html.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "url string, html string, error string"
NAME = "lensmark_pages"
#: Pages of one batch of a task.
AT_ONCE = 64


@dataclass
class Part(InputPartition):
    file: str
    group: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("pages need a path")
        self.path, self.fetch = options["path"], options.get("fetch")
        self.urls: list[list[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",) and f.value is not None:
                self.urls.append([f.value])
            elif isinstance(f, In) and f.attribute == ("url",):
                self.urls.append([v for v in f.value if v is not None])
            else:
                yield f

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Part]:
        files, path = self._open()
        found = [path]
        if files.get_file_info(path).type == fs.FileType.Directory:
            found = sorted(x.path for x in files.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.endswith(".parquet"))
        return [Part(f, i) for f in found for i in range(pq.ParquetFile(files.open_input_file(f)).num_row_groups)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        file = pq.ParquetFile(files.open_input_file(partition.file))
        fetch = None
        if self.fetch:
            module, _, function = self.fetch.partition(":")
            fetch = getattr(importlib.import_module(module), function)
        for batch in file.iter_batches(AT_ONCE, [partition.group], ["url"] if fetch else ["url", "html"]):
            for wanted in self.urls:
                batch = batch.filter(pc.is_in(batch.column("url"), pa.array(wanted, batch.column("url").type)))
            html, errors = [], []
            if fetch is None:
                html, errors = batch.column("html").to_pylist(), [None] * len(batch)
            else:
                for url in batch.column("url").to_pylist():
                    try:
                        html.append(fetch(url))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  whatever a fetch raises is a row's error
                        html.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("url").cast(pa.string()), pa.array(html, pa.string()), pa.array(errors, pa.string())], ["url", "html", "error"])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> str:
    """Makes the source known to a session, with filters pushed down, and returns its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return NAME
