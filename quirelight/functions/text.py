"""Text as Column expressions; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space as Python has it; Java's and RE2's own class is ASCII's
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# fixed values: the characters of a word when titles are normalised (Unicode letters and digits)
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
TOKEN = rf"[{SPACE}]*[^{SPACE}]+"  # lossless: the tokens of a stripped text join to it
MARKER = rf"^--- Page (\d+) ---[{SPACE}]*$"  # a page's first line, where ^ and $ are those of lines


def strip(x: Column) -> Column:
    """Without white space at either end (SQL's trim knows spaces only)."""
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(x: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(x), NOT_WORD, " "), rf"[{SPACE}]+", " "))


def clean_text(x: Column) -> Column:
    """Without page-marker lines; at most one blank line; single blanks; stripped."""
    out = F.regexp_replace(x, f"(?md){MARKER}", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def sentences(x: Column) -> Column:
    """array<string>: cut after each run of ``.!?;`` that white space follows."""
    marked = F.regexp_replace(x, rf"([.!?;]+[{SPACE}]+)", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(strip(s)) > 0)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def split_authors(x: Column) -> Column:
    """Names of a list such as ``Last, F. & Other, G.``; blank or null: empty."""
    marked = F.regexp_replace(x, r"(?<=[.)])\s*,\s+(?=[A-Z])", " & ")
    names = F.filter(F.transform(F.split(marked, " & "), strip), lambda s: F.length(s) > 0)
    return F.when(x.isNull(), F.expr("cast(array() as array<string>)")).otherwise(names)


def last_segment(url: Column) -> Column:
    """What follows the last slash, without query and fragment."""
    return F.substring_index(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/", -1)


def extension(url: Column) -> Column:
    """Lower-cased extension with its dot; none, or over 10 characters: '(no extension)'."""
    name = last_segment(url)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when((F.length(ext) > 1) & (F.length(ext) <= 10), ext).otherwise("(no extension)")


def year_in(x: Column) -> Column:
    """The first word of four digits."""
    return F.regexp_extract(x, r"\b(\d{4})\b", 1).try_cast("int")


def lecture_slug(stem: Column) -> Column:
    """A plain number before the first underscore, of two digits at least; else the cleaned stem."""
    head = F.split_part(stem, F.lit("_"), F.lit(1))
    plain = head.rlike(r"^(0|[1-9]\d{0,17})$")
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    other = F.when(safe == "", "unnamed").when(safe.rlike(r"^\d+$"), F.concat(F.lit("n"), safe)).otherwise(safe)
    return F.when(plain, F.when(F.length(head) < 2, F.lpad(head, 2, "0")).otherwise(head)).otherwise(other)


def lecture_number(stem: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.split_part(stem, F.lit("_"), F.lit(1)), r"^(\d+)$", 1).try_cast("int"), F.lit(0))


def absolute(url: Column, base: str) -> Column:
    """Site-relative urls get the base domain."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def normal_doi(x: Column) -> Column:
    """The bare identifier of a DOI or its url; other strings: null."""
    low = F.lower(strip(x))
    bare = F.regexp_replace(low, r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(low.contains("doi.org") | bare.startswith("10."), bare)


def human_size(n: Column) -> Column:
    kib = F.lit(1024.0)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / kib)).otherwise(F.format_string("%.1f MB", n / kib / kib))


def human_duration(s: Column) -> Column:
    s = s.cast("double")
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("long"), F.floor(s % 60).cast("long")))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")))
    )


def reference_line(authors: Column, year: Column, title: Column, url: Column) -> Column:
    """``A, B (2020). Title. url`` from what is there."""
    who = F.when(F.size(authors) > 0, F.array_join(authors, ", "))
    return F.concat_ws(" ", who, F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(")."))), F.concat(title, F.lit(".")), url)


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def iso_time(ts: Column) -> Column:
    """A moment as ``2020-01-02T03:04:05.000006``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
