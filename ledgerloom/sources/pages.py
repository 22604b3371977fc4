"""The signature feed as landed pages: a data source for batches and streams.

A feed is paged through newest first. Each reply lands as one page, a folder
`page=<number>` of JSON lines (signature, slot), newest first; pages that land later have
greater numbers and newer entries. `feed_pos` counts from the newest entry, so it is
least for the first line of the last page.

A batch reads one partition a page, and only the pages between its anchors. A stream has
its own offset, the number of the last page it has read; it stops before a page that is
still missing, so that none is skipped. A page must appear whole, as by renaming.

Paths are read through Arrow's file systems (local, HDFS, S3, GCS), on the driver for
listing and in the tasks for reading.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.sources.documents import arrow_files

NAME = "ledger_feed_pages"
PLACES = 1 << 20  # of a page in feed positions
SCHEMA = "signature string, slot bigint, feed_pos bigint"
ARROW = pa.schema([("signature", pa.string()), ("slot", pa.int64()), ("feed_pos", pa.int64())])
BATCH_LINES = 50_000


def feed_position(page: int, line: int) -> int:
    return -page * PLACES + line


def page_of(position: int) -> int:
    return -(position // PLACES)


@dataclass
class Page(InputPartition):
    number: int
    #: entries with after < feed_pos < up_to
    after: int | None = None
    up_to: int | None = None
    limit: int | None = None


class _Pages:
    """Landed pages under a path."""

    def __init__(self, path: str):
        self.path = path

    def numbers(self) -> list[int]:
        files, base = arrow_files(self.path)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = [f.base_name for f in found if f.type == fs.FileType.Directory]
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("page=") and n.split("=", 1)[1].isdigit())

    def lines(self, number: int) -> Iterator[str]:
        files, base = arrow_files(self.path)
        inside = files.get_file_info(fs.FileSelector(f"{base}/page={number}"))
        for info in sorted(inside, key=lambda f: f.path):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                with files.open_input_stream(info.path) as stream:
                    yield from _lines_of(stream)

    def entries(self, page: Page) -> Iterator[pa.RecordBatch]:
        held, taken = [], 0
        for line, text in enumerate(self.lines(page.number)):
            if line >= PLACES:
                raise ValueError(f"Page {page.number} has more than {PLACES} lines")
            place = feed_position(page.number, line)
            if (page.after is not None and place <= page.after) or not text:
                continue
            if (page.up_to is not None and place >= page.up_to) or (page.limit is not None and taken >= page.limit):
                break
            held.append(_entry(text, page.number) + (place,))
            taken += 1
            if len(held) >= BATCH_LINES:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _lines_of(raw) -> Iterator[str]:
    rest = b""
    while chunk := raw.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (w.decode() for w in whole)
    if rest:
        yield rest.decode()


def _entry(text: str, number: int) -> tuple[str | None, int | None]:
    try:
        row = json.loads(text)
        return row.get("signature"), None if row.get("slot") is None else int(row["slot"])
    except (ValueError, AttributeError) as error:
        raise ValueError(f"Page {number} holds a line that is no feed entry: {text[:100]}") from error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


class PageReader(DataSourceReader):
    """All pages, or those between two feed positions."""

    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options["path"])
        bound = lambda name: int(options[name]) if options.get(name) else None
        self.after, self.up_to, self.limit = bound("after"), bound("up_to"), bound("limit")

    def partitions(self) -> list[Page]:
        newest = None if self.after is None else page_of(self.after)
        oldest = None if self.up_to is None else page_of(self.up_to)
        numbers = [n for n in self.pages.numbers() if (newest is None or n <= newest) and (oldest is None or n >= oldest)]
        return [Page(n, self.after, self.up_to, self.limit) for n in reversed(numbers)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        # without any page Spark reads one partition that is none
        return iter(()) if partition is None else self.pages.entries(partition)


class PageStreamReader(DataSourceStreamReader):
    """Pages as they land. The offset is the number of the last page read."""

    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options["path"])
        self.first = int(options.get("first_page") or 0)

    def initialOffset(self) -> dict:
        return {"page": self.first - 1}

    def latestOffset(self) -> dict:
        landed = set(self.pages.numbers())
        last = self.first - 1
        while last + 1 in landed:
            last += 1
        return {"page": last}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.pages.entries(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStreamReader(dict(self.options))


def _loaded(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FeedPages)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(NAME).option("path", path).options(**given).load()


def read_feed_pages(
    spark: SparkSession, path: str, before: str | None = None, until: str | None = None, limit: int | None = None
) -> DataFrame:
    """Entries older than `before` and newer than `until`, both left out, and of these the newest `limit`.

    The anchors are looked up by a job over the pages; then only the pages between them
    are read. An absent `before` is an error; an absent `until` reads to the oldest entry. Of
    an anchor that the feed holds repeatedly the newest place counts.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    wanted = [s for s in (before, until) if s is not None]
    places = {}
    if wanted:
        found = _loaded(spark, path).where(F.col("signature").isin(wanted)).groupBy("signature").agg(F.min("feed_pos").alias("place"))
        places = {r.signature: r.place for r in found.collect()}
    if before is not None and before not in places:
        raise ValueError(f"Signature {before} is not in the feed")
    rows = _loaded(spark, path, after=places.get(before), up_to=places.get(until), limit=limit)
    return rows if limit is None else rows.orderBy("feed_pos").limit(limit)


def stream_feed_pages(spark: SparkSession, path: str, first_page: int = 0) -> DataFrame:
    """Entries of pages as they land, from page `first_page` on."""
    spark.dataSource.register(FeedPages)
    return spark.readStream.format(NAME).option("path", path).option("first_page", str(first_page)).load()


def land_pages(feed: DataFrame, path: str, page: str = "page") -> None:
    """Write a feed (signature, slot, feed_pos and a page number) as pages, newest entry first."""
    rows = feed.repartition(page).sortWithinPartitions(page, "feed_pos")
    rows.select(page, "signature", "slot").withColumnRenamed(page, "page").write.partitionBy("page").mode("append").json(path)
