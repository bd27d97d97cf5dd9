"""Stable identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

# fixed values: namespace of point ids, prefixes of the two catalogues
POINT_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
SITE, API = "gl", "oa"


def short_hash(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of a name (RFC 4122, section 4.3)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8)), -1, 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def _tail(url: Column, marker: str) -> Column:
    """After the last marker, without query, fragment and trailing slashes."""
    rest = F.substring_index(url, marker, -1)
    return F.regexp_replace(F.split_part(F.split_part(rest, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")


def metadata_base(title: Column, authors: Column, year: Column) -> Column:
    """``t:..._a:..._y:...`` of what is there; '' if nothing is."""
    part = lambda tag, x: F.when(x != "", F.concat(F.lit(tag), x))
    return F.concat_ws("_", part("t:", normalize_text(title)), part("a:", normalize_text(F.array_join(authors, " "))), F.when(year != 0, F.concat(F.lit("y:"), year.cast("string"))))


def _metadata_id(prefix: str, title: Column, authors: Column, year: Column) -> Column:
    base = metadata_base(title, authors, year)
    stamp = F.coalesce(F.when(year != 0, year.cast("string")), F.lit("0000"))
    return F.when(base != "", F.concat(F.lit(prefix + "_"), stamp, F.lit("_"), short_hash(base))).otherwise(F.concat(F.lit(prefix + "_unknown_"), short_hash(F.uuid())))


def site_id(paper_id: Column, url: Column, title: Column, authors: Column, year: Column, prefix: str = SITE) -> Column:
    """Given id, else a hash of the url's slug, else of the metadata."""
    low = F.lower(url)
    slug = F.when(low.contains("/publications/"), _tail(low, "/publications/")).when(low.contains("/publication/"), _tail(low, "/publication/"))
    return F.when(paper_id != "", paper_id).when(slug != "", F.concat(F.lit(prefix + "_url_"), short_hash(slug))).otherwise(_metadata_id(prefix, title, authors, year))


def api_id(paper_id: Column, urls: Column, url: Column, title: Column, authors: Column, year: Column, prefix: str = API) -> Column:
    """Catalogue id, else a hash of the first DOI, of the url, of the metadata."""
    dois = F.filter(F.transform(F.filter(urls, lambda u: F.lower(u).contains("doi.org")), lambda u: _tail(F.lower(u), "doi.org/")), lambda d: d != "")
    doi = F.get(dois, F.lit(0))
    return (
        F.when(paper_id.startswith("W"), F.concat(F.lit(prefix + "_"), paper_id))
        .when(doi.isNotNull(), F.concat(F.lit(prefix + "_doi_"), short_hash(doi)))
        .when(url != "", F.concat(F.lit(prefix + "_url_"), short_hash(F.lower(url))))
        .otherwise(_metadata_id(prefix, title, authors, year))
    )


def content_hash(title: Column, authors: Column, year: Column, abstract: Column, url: Column, file_urls: Column) -> Column:
    """SHA-256 of the fields joined by underscores; a list prints as ['a', 'b'], null as None."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    quoted = F.transform(authors, lambda a: F.concat(F.lit("'"), a, F.lit("'")))
    shown = F.coalesce(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), F.lit("None"))
    files = F.array_join(F.transform(F.coalesce(file_urls, F.expr("cast(array() as array<string>)")), lambda u: F.concat(F.lit("_"), u)), "")
    return F.sha2(F.concat(text(title), F.lit("_"), shown, F.lit("_"), text(year), F.lit("_"), text(abstract), F.lit("_"), text(url), files).cast("binary"), 256)


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document.cast("string"), index)
