"""Downloads: destinations, validity, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, last_segment

LEAST_BYTES, MOST_BYTES = 1024, 100 * 1024 * 1024
# fixed values: extension of a content type
CONTENT_TYPES = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}
# fixed values: content types of files
DIRECT_TYPES = ("application/pdf", "application/octet-stream", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
WORD_TYPES = [t for t, e in CONTENT_TYPES.items() if e in (".doc", ".docx")]


def file_name(url: Column) -> Column:
    """The url's last segment if it has an extension, else a short hash."""
    name = last_segment(url)
    return F.when(name.contains("."), name).otherwise(F.concat(F.substring(F.md5(url.cast("binary")), 1, 8), F.lit(".bin")))


def corrected_name(name: Column, content_type: Column) -> Column:
    """The name with the extension that the content type asks for."""
    base = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    wanted = F.get(F.array(table[base]), F.lit(0))
    has = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return F.when(wanted.isNotNull() & (has != wanted), F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), wanted)).otherwise(name)


def planned(publications: DataFrame, key: str, urls: str) -> DataFrame:
    """key, url, path of every file of publications that have any."""
    rows = publications.where(F.size(urls) > 0).select(key, F.explode(urls).alias("url"))
    return rows.select(key, "url", F.concat_ws("/", F.lit("raw/documents"), F.col(key).cast("string"), file_name(F.col("url"))).alias("path"))


def hashed_plan(publications: DataFrame, key: str, urls: str, guess: str = "", folder: str = "raw/documents/openalex") -> DataFrame:
    """key, url, path as the API's catalogue lays files out: the md5 of the url without query and fragment, with its extension.

    Rows that repeat an address but for its query share a file.  A url without
    an extension gets ``guess``.
    """
    rows = publications.where(F.size(urls) > 0).select(key, F.explode(urls).alias("url"))
    bare = F.regexp_extract("url", r"(?s)^([^?#]*)", 1)
    within = F.regexp_extract(bare, r"(?s)^[^:/]*://[^/]*(/.*)$", 1)
    suffix = F.lower(F.regexp_extract(within, r"[^/.][^/]*?(\.[^./]+)$", 1))
    name = F.concat(F.md5(bare.cast("binary")), F.when(suffix == "", F.lit(guess)).otherwise(suffix))
    return rows.select(key, "url", F.concat_ws("/", F.lit(folder), F.col(key).cast("string"), name).alias("path"))


def validity(size: Column, name: Column, header: Column, content_type: Column, html_passes: bool = False, both_for_pdf: bool = True) -> Column:
    """'ok' or why a file is refused; ``header`` holds its first bytes.

    The two catalogues differ: one checks the PDF mark if type and suffix say
    PDF and refuses HTML, the other if either says so and lets HTML pass.
    """
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    typed, named = F.coalesce(content_type == "application/pdf", F.lit(False)), suffix == ".pdf"
    pdf = (typed & named) if both_for_pdf else (typed | named)
    word = F.coalesce(content_type.isin(WORD_TYPES), F.lit(False)) | suffix.isin(".doc", ".docx")
    mark = F.hex(header)
    text = F.lower(F.regexp_replace(F.decode(header, "ISO-8859-1"), r"^\s+", ""))
    html = F.coalesce(content_type == "text/html", F.lit(False)) | text.startswith("<!doctype html") | text.startswith("<html")
    fine = F.lit("ok")
    out = F.when(size < LEAST_BYTES, "too small").when(size > MOST_BYTES, "too large")
    out = out.when(pdf, F.when(mark.startswith("255044462D"), fine).otherwise("not a PDF"))
    out = out.when(word, F.when(mark.startswith("D0CF11E0A1B11AE1") | mark.startswith("504B0304"), fine).otherwise("not a Word file"))
    if not html_passes:
        out = out.when(html, "HTML page")
    return out.when(F.length(header) > 0, fine).otherwise("empty")


def is_pdf(path: Column, content: Column) -> Column:
    """By extension or mark, but not a partial file."""
    low = F.lower(path)
    return (low.endswith(".pdf") | F.hex(F.substring(content, 1, 5)).startswith("255044462D")) & ~low.endswith(".part")


def rolled_up(results: DataFrame, key: str, success: str, error: str, order: str) -> DataFrame:
    """key, status, error: Downloaded if all succeeded, else the errors in order."""
    bad = F.array_sort(F.collect_list(F.when(~F.col(success) & (F.coalesce(F.col(error), F.lit("")) != ""), F.struct(F.col(order).alias("o"), F.col(error).alias("e")))))
    told = F.array_join(F.transform("bad", lambda x: x["e"]), "; ")
    rows = results.groupBy(key).agg(F.bool_and(success).alias("all_ok"), bad.alias("bad"))
    return rows.select(key, F.when(F.col("all_ok"), "Downloaded").otherwise("Failed").alias("status"), F.when(~F.col("all_ok"), F.when(F.size("bad") > 0, told).otherwise("Download failed")).alias("error"))


def totals(results: DataFrame, success: str, size: str) -> DataFrame:
    """attempted, successful, failed, bytes, megabytes, success_rate: one row."""
    good = F.col(success)
    sums = results.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col(size))), F.lit(0)).cast("double").alias("bytes"))
    return sums.select("attempted", "successful", "failed", F.round("bytes", 2).alias("bytes"), F.round(F.col("bytes") / 1024 / 1024, 4).alias("megabytes"), F.round(100.0 * F.col("successful") / F.greatest("attempted", F.lit(1)), 4).alias("success_rate"))


def extension_histogram(urls: DataFrame, url: str) -> DataFrame:
    """extension, n, most frequent first."""
    return urls.groupBy(extension(F.col(url)).alias("extension")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension")


def url_totals(urls: DataFrame, url: str) -> DataFrame:
    return urls.agg(F.count(url).alias("total"), F.count_distinct(url).alias("distinct_urls"), (F.count(url) - F.count_distinct(url)).alias("duplicates"))


def resume(status: Column, has_part: Column, part_size: Column, total: Column) -> Column:
    """What to do with a response: the decision table of a resumed download."""
    return (
        F.when((status == 206) & has_part, "append")
        .when(status == 200, "restart")
        .when((status == 416) & has_part & (part_size == total), "complete")
        .when((status == 416) & has_part, "discard and restart")
        .when(status.isin(429, 500, 502, 503, 504), "retry")
        .otherwise("fail")
    )


def is_direct(content_type: Column, disposition: Column) -> Column:
    """Whether a response is a file: by its type, or since it names one or says it is an attachment."""
    kind, told = (F.lower(F.coalesce(x, F.lit(""))) for x in (content_type, disposition))
    out = told.contains("attachment") | told.contains("filename=")
    for known in DIRECT_TYPES:
        out = out | kind.contains(known)
    return out


def extraction_status(text: Column, least: int) -> Column:
    """Processed, or Failed for a text below ``least`` characters."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= least, "Processed").otherwise("Failed")


def counters(results: DataFrame, cached: Column, open_access: Column) -> DataFrame:
    """One row: attempted, cached, open_access and the latter's share in percent."""
    s = results.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(cached).alias("cached"), F.count_if(open_access).alias("open_access"))
    return s.withColumn("open_share", F.round(100.0 * F.col("open_access") / F.greatest("attempted", F.lit(1)), 1))
