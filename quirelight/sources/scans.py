"""Catalogue pages and API works as Spark data sources over any transport.

``register(spark)`` makes two formats known:

* ``catalogue``: a paginated HTML catalogue.  The first page tells how many
  there are; each page is a partition, fetched and parsed where it runs.  A page
  that keeps failing gives no rows.  Filters on ``page`` choose the partitions.
* ``works``: a JSON API that hands out a cursor with each page.  Filters on
  author, year and version go into the address; each author is a partition,
  whose cursor is followed in turn.  An empty page goes on; a page that keeps
  failing fails the read, for a part must not pass for the whole.  As a stream
  the cursor is the offset.

A transport is a callable (address, body or None) -> text, named by option
``transport`` as ``module:function``, so that it is found on every machine;
the default is plain HTTP.  It raises ``Refused`` with a status.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, SimpleDataSourceStreamReader

Transport = Callable[[str, dict | None], str]
ENTRIES = "page int, nth int, title string, pub_url string, authors string, year int, abstract string, file_urls array<string>"
WORKS = "author string, year int, version string, id string, title string, doi string, record string"
PER_SCAN_PAGE = 15  # entries that a page of a catalogue is reckoned to have
PER_API_PAGE = 200
RETRIED = frozenset({429, 500, 502, 503, 504})


class Refused(OSError):
    """An answer that is not 200."""

    def __init__(self, status: int, address: str) -> None:
        super().__init__(f"status {status} for {address}")
        self.status = status


def http(address: str, body: dict | None = None) -> str:
    data = None if body is None else json.dumps(body).encode()
    try:
        with urlopen(Request(address, data, {"Content-Type": "application/json"} if data else {}), timeout=60) as answer:  # noqa: S310
            return answer.read().decode()
    except HTTPError as e:
        raise Refused(e.code, address) from e


def _transport(options: dict) -> Transport:
    module, _, name = options.get("transport", f"{__name__}:http").partition(":")
    return getattr(importlib.import_module(module), name)


def fetched(get: Transport, address: str, body: dict | None, tries: int, pause: float, all_statuses: bool) -> str:
    """An answer after ``tries`` at most; a status that no repeat mends is raised at once unless ``all_statuses`` are repeated."""
    for attempt in range(tries):
        try:
            return get(address, body)
        except Refused as e:
            if attempt + 1 == tries or not (all_statuses or e.status in RETRIED):
                raise
        except OSError:
            if attempt + 1 == tries:
                raise
        time.sleep(pause * 2**attempt)
    raise ValueError("no tries")


# ---- HTML catalogues


def told_pages(html: str) -> int:
    """Pages by the settings that the page embeds; without them 1 if it has entries, else 0."""
    from ..operators.catalog import entries_of

    found = re.search(r"FWP_JSON\s*=\s*(\{.*?\});?\s*(?:</script>|\n|$)", html, re.DOTALL)
    try:
        told = int(json.loads(found[1])["preload_data"]["settings"]["pager"]["total_pages"]) if found else 0
    except (ValueError, KeyError, TypeError):
        told = 0
    return told or int(bool(entries_of(html, "")))


def page_body(page: int) -> dict:
    """What is posted for a page after the first."""
    # fixed values: the request of the catalogue's pager
    empty = {"search": "", **{facet: [] for facet in ("policy_area", "format", "geography", "year", "research_project", "research_type", "author")}}
    return {
        "action": "facetwp_refresh",
        "data": {
            "facets": empty, "frozen_facets": {}, "http_params": {"get": {}, "uri": "publications-home/repository", "url_vars": {}}, "template": "wp",
            "extras": {"pager": True, "per_page": "default", "counts": True}, "soft_refresh": 0, "is_bfcache": 0, "first_load": 0, "paged": page,
        },
    }


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        super().__init__(page)
        self.page = page


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.address, self.options = options["path"], dict(options)
        self.tries, self.pause, self.most = int(options.get("tries", 3)), float(options.get("pause", 1.0)), int(options.get("pages", 0))
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("page",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[_Page]:
        try:
            n = told_pages(fetched(_transport(self.options), self.address, None, self.tries, self.pause, False))
        except Refused as e:
            if e.status in RETRIED:
                raise
            n = 0
        pages = range(1, (min(n, self.most) if self.most else n) + 1)
        return [_Page(p) for p in pages if self.wanted is None or p in self.wanted] or [_Page(0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from ..operators.catalog import entries_of

        if not partition.page:
            return
        try:
            body = None if partition.page == 1 else page_body(partition.page)
            answer = fetched(_transport(self.options), self.address, body, self.tries, self.pause, False)
            html = answer if body is None else json.loads(answer)["template"]
        except (OSError, ValueError, KeyError, TypeError):  # a page that fails has no entries
            return
        for nth, entry in enumerate(entries_of(html, self.address)):
            yield (partition.page, nth, *entry)


class Catalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: object) -> CatalogueReader:
        return CatalogueReader(self.options)


def scan_catalogue(spark: SparkSession, address: str, limit: int = 0, **options: str) -> DataFrame:
    """Publications of a catalogue, each once (by its API id), in page order; with a limit so many of as few pages as should have them."""
    from ..functions.ids import site_id
    from ..functions.text import split_authors
    from ..operators.tracking import first_wins

    reader = spark.read.format("catalogue").options(**options)
    if limit:
        reader = reader.option("pages", max(1, limit // PER_SCAN_PAGE + 1))
    rows = reader.load(address).withColumn("paper_id", site_id(F.lit(""), F.col("pub_url"), F.col("title"), split_authors(F.col("authors")), F.col("year")))
    unique = first_wins(rows.where("paper_id is not null"), ["paper_id"], ["page", "nth"])
    return unique.orderBy("page", "nth").limit(limit) if limit else unique


# ---- API works


def works_address(base: str, author: str, year: int | None, version: str | None, without: str | None, cursor: str | None, mail: str = "") -> str:
    """The address of a page of works, with what is asked of them."""
    asked = [f"authorships.author.id:A{author.removeprefix('A')}"]
    asked += [f"publication_year:{year}"] if year is not None else []
    asked += [f"primary_location.version:{version}"] if version is not None else []
    asked += [f"primary_location.version:!{without}"] if without is not None else []
    tail = (f"&mailto={mail}" if mail else "") + (f"&cursor={quote(cursor, safe='*=')}" if cursor else "") + f"&per-page={PER_API_PAGE}"
    return f"{base}/works?filter={','.join(asked)}{tail}"


def _row(author: str, work: dict) -> tuple:
    version = (work.get("primary_location") or {}).get("version")
    return author, work.get("publication_year"), version, work.get("id"), work.get("title"), work.get("doi"), json.dumps(work, sort_keys=True)


class _Author(InputPartition):
    def __init__(self, author: str) -> None:
        super().__init__(author)
        self.author = author


class WorksReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.options = options["path"].rstrip("/"), dict(options)
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 5.0))
        self.most_empty = int(options.get("empty", 10))
        self.authors = [a for a in options.get("authors", "").split(",") if a]
        self.year, self.version, self.without = None, None, options.get("without")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {("author",)} | {f.attribute for f in filters if isinstance(f, EqualTo)}  # which are no nulls then
        for f in filters:
            name = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and name == ("author",):
                self.authors = [a for a in self.authors or [f.value] if a == f.value]
            elif isinstance(f, In) and name == ("author",):
                self.authors = [a for a in self.authors or list(f.value) if a in f.value]
            elif isinstance(f, EqualTo) and name == ("year",) and self.year in (None, f.value):
                self.year = f.value
            elif isinstance(f, EqualTo) and name == ("version",) and self.version in (None, f.value):
                self.version = f.value
            elif isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("version",) and self.without in (None, f.child.value):
                self.without = f.child.value
                yield f  # the API keeps works without a version, which the filter does not
            elif not (isinstance(f, IsNotNull) and name in known):
                yield f

    def partitions(self) -> list[_Author]:
        if not self.authors and "authors" not in self.options:
            raise ValueError("name the authors, by option authors or a filter on author")
        return [_Author(a) for a in self.authors] or [_Author("")]

    def address(self, author: str, cursor: str | None) -> str:
        return works_address(self.base, author, self.year, self.version, self.without, cursor, self.options.get("mail", ""))

    def page(self, author: str, cursor: str) -> tuple[list[dict], str | None]:
        answer = json.loads(fetched(_transport(self.options), self.address(author, cursor), None, self.tries, self.pause, True))
        return answer.get("results") or [], (answer.get("meta") or {}).get("next_cursor")

    def read(self, partition: _Author) -> Iterator[tuple]:
        cursor, empty = "*" if partition.author else None, 0
        while cursor:
            works, cursor = self.page(partition.author, cursor)
            empty += not works
            if empty >= self.most_empty:
                raise OSError(f"{empty} empty pages: the works of {partition.author} are not known to be complete")
            for work in works:
                yield _row(partition.author, work)


class WorksStream(SimpleDataSourceStreamReader):
    """One author's works; a page a batch, whose offset is the cursor after it."""

    def __init__(self, options: dict) -> None:
        self.of = WorksReader(options)
        if len(self.of.authors) != 1:
            raise ValueError("a stream of works has one author")

    def initialOffset(self) -> dict:
        return {"cursor": "*"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["cursor"] is None:
            return iter(()), start
        works, cursor = self.of.page(self.of.authors[0], start["cursor"])
        return iter([_row(self.of.authors[0], w) for w in works]), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["cursor"] is not None and start != end:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        """Nothing is held for a cursor."""


class Works(DataSource):
    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return WORKS

    def reader(self, schema: object) -> WorksReader:
        return WorksReader(self.options)

    def simpleStreamReader(self, schema: object) -> WorksStream:
        return WorksStream(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalogue)
    spark.dataSource.register(Works)
