"""Catalogue records: API documents, inverted abstracts, tagged references, HTML."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_authors, year_in


def inverted_text(index: Column) -> Column:
    """Text of a map word -> positions; gaps are empty words, the later word of a clash holds."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    last = F.array_max(F.transform(spots, lambda s: s["p"]))
    at = lambda k: F.array_max(F.filter(spots, lambda s: s["p"] == k))["w"]
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("int"), last.cast("int")), lambda k: F.coalesce(at(k), F.lit(""))), " ")).otherwise("")


def api_records(raw: DataFrame) -> DataFrame:
    """Publications of API documents with id, publication_year, authorships, ..."""
    bare = F.regexp_replace("id", r"^https?://[^/]+/", "")
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    return raw.select(
        bare.alias("paper_id"), F.col("id").alias("source_id"), "title", F.coalesce(names, none).alias("authors"), F.col("publication_year").alias("year"),
        inverted_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("primary_location.landing_page_url").alias("pub_url"),
        F.when(F.col("doi").isNotNull(), F.array("doi")).otherwise(none).alias("file_urls"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
    )


def tagged_reference(text: Column) -> Column:
    """struct(authors, title, date, abstract) of lines ``%A``, ``%T``, ``%D``, ``%X``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("%"))
    values = lambda tag: F.transform(F.filter(lines, lambda x: F.substring(x, 2, 1) == tag), lambda x: F.trim(F.substring(x, 4, 1 << 30)))
    last = lambda tag: F.try_element_at(values(tag), F.lit(-1))
    turned = F.transform(values("A"), lambda a: F.when(F.size(F.split(a, ", ")) == 2, F.concat_ws(" ", F.split(a, ", ")[1], F.split(a, ", ")[0])).otherwise(a))
    plain = F.trim(F.regexp_replace(F.regexp_replace(last("X"), "<[^>]*>", " "), r"\s+", " "))
    return F.struct(turned.alias("authors"), last("T").alias("title"), last("D").alias("date"), plain.alias("abstract"))


def enriched(own: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Fill a missing year; take a longer abstract and a longer list of authors."""
    f = found.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("year", "abstract", "authors")])
    rows = own.join(f, F.col(key) == F.col("__k"), "left")
    longer = lambda c, size: F.when(F.coalesce(size(F.col(f"__{c}")), F.lit(0)) > F.coalesce(size(F.col(c)), F.lit(0)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in own.columns if c not in ("year", "abstract", "authors")]
    return rows.select(*rest, F.coalesce("year", "__year").alias("year"), longer("abstract", F.length), longer("authors", F.size))


def structured_data(html: Column) -> Column:
    """struct(year, authors) of a page's first JSON-LD article, alone or in a graph."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    kind = "struct<`@type`:string,datePublished:string,author:string,`@graph`:array<struct<`@type`:string,datePublished:string,author:string>>>"
    parsed = F.transform(scripts, lambda s: F.from_json(s, kind))
    own = F.transform(parsed, lambda p: F.struct(p["@type"].alias("type"), p["datePublished"].alias("date"), p["author"].alias("author")))
    graph = F.flatten(F.filter(F.transform(parsed, lambda p: F.transform(p["@graph"], lambda g: F.struct(g["@type"].alias("type"), g["datePublished"].alias("date"), g["author"].alias("author")))), lambda x: x.isNotNull()))
    found = F.get(F.filter(F.concat(own, graph), lambda a: a["type"] == "ScholarlyArticle"), F.lit(0))
    one = F.get_json_object(found["author"], "$.name")
    several = F.filter(F.transform(F.from_json(found["author"], "array<string>"), lambda a: F.coalesce(F.get_json_object(a, "$.name"), F.when(~a.startswith("{"), a))), lambda a: a != "")
    authors = F.coalesce(F.when(found["author"].startswith("["), several), F.when(one != "", F.array(one)), F.expr("cast(array() as array<string>)"))
    return F.struct(year_in(found["date"]).alias("year"), authors.alias("authors"))


def open_access(first: Column, second: Column) -> Column:
    """The url of an open copy: the first service's PDF, else its page, else the second's first result."""
    own = F.coalesce(F.nullif(F.get_json_object(first, "$.best_oa_location.url_for_pdf"), F.lit("")), F.nullif(F.get_json_object(first, "$.best_oa_location.url"), F.lit("")))
    return F.coalesce(F.when(F.get_json_object(first, "$.is_oa") == "true", own), F.nullif(F.get_json_object(second, "$.data[0].downloadUrl"), F.lit("")))


def page_count(html: Column, entries: Column) -> Column:
    """Pages of a catalogue, from its embedded settings; without them 1 if there are entries, else 0."""
    told = F.get_json_object(F.regexp_extract(html, r"(?s)FWP_JSON\s*=\s*(\{.*?\});?\s*(?:</script>|\n|$)", 1), "$.preload_data.settings.pager.total_pages").try_cast("int")
    return F.coalesce(told, F.when(entries > 0, 1).otherwise(0))


def api_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of stored API answers (JSON objects with ``results``); an answer that does not parse fails the read."""
    raw = spark.read.schema(f"results array<{schema}>, meta struct<next_cursor:string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.explode("results").alias("r")).select("r.*")


def api_url(base: str, author: str, cursor: str = "*", per_page: int = 200, version: str = "submittedVersion") -> str:
    """The address of a page of an author's works, without submitted versions."""
    return f"{base}/works?filter=author.id:{author},primary_location.version:!{version}&per-page={per_page}&cursor={cursor}"


def cursor_pages(fetch: Callable[[str], dict], tries: int = 3) -> Iterator[dict]:
    """Records of a cursor's pages until it is null; an empty page goes on, a page that keeps failing raises."""
    cursor: str | None = "*"
    while cursor:
        for attempt in range(tries):
            try:
                page = fetch(cursor)
                break
            except Exception:
                if attempt + 1 == tries:
                    raise
        yield from page.get("results", [])
        cursor = (page.get("meta") or {}).get("next_cursor")


def corrected_years(records: DataFrame, corrections: dict[str, int]) -> DataFrame:
    """Years by url where a correction is stated."""
    if not corrections:
        return records
    table = F.create_map(*[F.lit(x) for kv in corrections.items() for x in kv])
    return records.withColumn("year", F.coalesce(F.get(F.array(table[F.col("pub_url")]), F.lit(0)), F.col("year")))


def coerced(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): bare ids, full source ids, years from 1900 to 2100."""
    host = "https://openalex.org/"  # fixed value: the API's id prefix
    bare = F.when(F.col("paper_id").startswith(host), F.substring("paper_id", len(host) + 1, 1 << 30)).otherwise(F.col("paper_id"))
    rows = records.withColumn("paper_id", bare)
    source = F.col("source_id") if "source_id" in records.columns else F.lit(None).cast("string")
    rows = rows.withColumn("source_id", F.coalesce(F.nullif(source, F.lit("")), F.concat(F.lit(host), F.col("paper_id"))))
    reason = F.when((F.col("year") != 0) & ((F.col("year") < 1900) | (F.col("year") > 2100)), F.concat(F.lit("year out of range: "), F.col("year").cast("string")))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


_EMPTY = {"br", "meta", "link", "img", "input", "hr"}


class _Node:
    """An element; children are elements and texts."""

    def __init__(self, tag: str, attrs: dict, up: _Node | None) -> None:
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def all(self, tag: str | None = None, name: str | None = None) -> Iterator[_Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            if (tag is None or node.tag == tag) and (name is None or name in (node.attrs.get("class") or "").split()):
                yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def first(self, *wanted: tuple[str, str | None]) -> _Node | None:
        return next((n for tag, name in wanted for n in self.all(tag, name)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def after(self) -> str:
        """The text right after this element."""
        around = self.up.children if self.up else [self]
        k = around.index(self) + 1
        return around[k] if k < len(around) and isinstance(around[k], str) else ""


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _EMPTY:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up and node.tag != tag:
            node = node.up
        if node.up:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


# fixed values: class names of the two layouts, the newer first
_TITLE = (("h2", "publication-title"), ("span", "biblio-title"))
_AUTHORS = (("p", "publication-authors"), ("span", "biblio-authors"))
_ABSTRACT = (("div", "publication-excerpt"), ("div", "biblio-abstract-display"))
_YEAR = re.compile(r"\b\d{4}\b")


def _entry(node: _Node, base: str) -> tuple | None:
    """(title, url, authors as written, year, abstract, file urls) of one entry; None without a title."""
    site = base.split("/publications")[0] if "/publications" in base else base.split("/repository")[0]
    full = lambda url: url if not url or url.startswith(("http://", "https://")) else site + url
    title = node.first(*_TITLE)
    if title is None:
        return None
    link, written, year, abstract = title.first(("a", None)), None, None, None
    if (authors := node.first(*_AUTHORS)) is not None:
        dated = authors.first(("span", "publication-year"))
        written, spot = authors.text(), (dated.text() if dated else authors.after())
        if dated:
            written = written.replace(spot, "").strip().rstrip(",")
        year = int(m[0]) if (m := _YEAR.search(spot)) else None
    if (body := node.first(*_ABSTRACT)) is not None:
        abstract = (body.first(("div", None)) or body).text().strip()
    box = node.first(("div", "publication-links"))
    if box is not None:
        links = [a for a in box.all("a") if "abstract" not in (a.attrs.get("class") or "").split()]
        urls = [u for a in links if (u := a.attrs.get("href")) and not u.startswith("#")]
    else:
        urls = [u for f in node.all("span", "file") if (a := f.first(("a", None))) and (u := a.attrs.get("href"))]
    return (link or title).text().strip(), full(link.attrs.get("href")) if link else None, (written or "").strip() or None, year, abstract, [full(u) for u in urls]


def entries_of(html: str, base: str) -> list[tuple]:
    """The publications of a page, in either layout."""
    tree = _Tree()
    tree.feed(html)
    nodes = list(tree.root.all("div", "cp-publication")) or list(tree.root.all("div", "biblio-entry"))
    return [found for node in nodes if (found := _entry(node, base))]


def parsed_entries(pages: DataFrame, base: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, nth, title, pub_url, authors, year, abstract, file_urls of each publication on each page, in either layout."""
    kinds = {"id": pa.int64(), "nth": pa.int32(), "title": pa.string(), "pub_url": pa.string(), "written": pa.string(), "year": pa.int32(), "abstract": pa.string(), "file_urls": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(key, k, *found) for k, found in enumerate(entries_of(html or "", base))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    made = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, nth int, title string, pub_url string, written string, year int, abstract string, file_urls array<string>")
    return made.select("id", "nth", "title", "pub_url", split_authors(F.col("written")).alias("authors"), "year", "abstract", "file_urls")


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, title, heading, n_links of every page, by a tolerant parser."""
    kinds = {"id": pa.int64(), "title": pa.string(), "heading": pa.string(), "n_links": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = _Tree()
                tree.feed(html or "")
                inside = lambda tag: "".join(n.text() for n in tree.root.all(tag)).strip()  # noqa: E731, B023
                rows.append((key, inside("title"), inside("h1"), sum(1 for a in tree.root.all("a") if a.attrs.get("href"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, title string, heading string, n_links int")
