"""Token-bounded chunks of documents.

Windows and sections are made within a row, so they need no shuffle; pages meet
chunks within a row or, from two tables, bin by bin.  Sentence packing is a fold
whose state hangs on every earlier sentence; like the windows, it runs over Arrow
batches, a document at a time.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.ids import chunk_id
from ..functions.text import MARKER, SPACE, clean_text, strip

# fixed values: markdown header, numbered header, upper-case label
HEADERS = (r"^#{1,6}\s+", r"^\d+\.\s+", r"^[A-Z][A-Z\s]+:")
_TOKEN, _END, _HEADER = re.compile(r"\s*\S+"), re.compile(r"[.!?;]+\s+"), re.compile("|".join(HEADERS))
_OUT_CHARS = 1 << 21  # of chunks in a batch of results
_PAGE = re.compile(r"--- Page (\d+) ---\s*$")
Tokeniser = Callable[[str], list[str]]  # its tokens, of a stripped text, join to the text


def plain_tokens(text: str) -> list[str]:
    """Words, each with the white space before it."""
    return _TOKEN.findall(text)


def ranked_tokens(path: str, pattern: str = r"\s*\S+") -> Tokeniser:
    """Tokens of a byte-pair vocabulary (a file with lines ``base64 rank``); read where it runs.

    Tokens that split a character are joined, so that every token is text.
    """
    made: list = []

    def tokenise(text: str) -> list[str]:
        if not made:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
            made.append(tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        out, held = [], b""
        for token in made[0].encode_ordinary(text):
            held += made[0].decode_single_token_bytes(token)
            try:
                out.append(held.decode())
                held = b""
            except UnicodeDecodeError:
                continue
        return out

    return tokenise


@dataclass(frozen=True)
class Limits:
    """Sizes in tokens; ``fitted`` repairs what contradicts the model's limit."""

    size: int = 500
    overlap: int = 50
    least: int = 50
    most: int = 2000

    def fitted(self, model_limit: int | None = None) -> Limits:
        """With sizes that fit each other, and a margin of 100 below the model's limit."""
        most = min(self.most, model_limit - 100) if model_limit else self.most
        size = min(max(self.size, 1), most)
        return Limits(size, self.overlap if 0 <= self.overlap < size else size // 10, min(self.least, size), most)

    @property
    def step(self) -> int:
        return self.size - self.overlap if self.overlap < self.size else self.size


@F.arrow_udf(ArrayType(IntegerType()))
def running(lengths: pa.Array) -> pa.Array:
    """The sum of an array's numbers before each of them; one pass, whatever the arrays' sizes."""
    cuts = lengths.offsets.to_numpy()
    flat = lengths.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(flat)])
    starts = cuts - cuts[0]
    sums = before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sums.astype(np.int32)), mask=lengths.is_null())


def _windows(text: str, limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of each window; tokens lie end to end, so a window is a part of the text."""
    ends = [0, *(m.end() for m in _TOKEN.finditer(text))]
    n = len(ends) - 1
    for s in range(0, n, limits.step):
        if s == 0 or n - s >= limits.least:
            e = min(n, s + limits.size)
            yield ends[s], ends[e], e - s
        if n < limits.least:
            return


def fixed_windows(docs: DataFrame, limits: Limits, id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """doc, chunk_index, chunk_id, char_start, char_end, n_tokens, text.

    A text below the least size is one chunk; a last window below it is left
    out; windows go on to the end even if the one before reached it.
    """
    text = clean_text(docs[text_col]) if clean else docs[text_col]
    rows = docs.select(docs[id_col].alias("doc"), F.coalesce(text, F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, row_of = [], 0, []
            for i, value in enumerate(batch.column(1)):
                body = value.as_py()
                for k, (a, e, n) in enumerate(_windows(body, limits)):
                    found.append((k, a, e, n, body[a:e]))
                    row_of.append(i)
                    held += e - a
                    if held > _OUT_CHARS:
                        yield made(batch, row_of, found)
                        found, held, row_of = [], 0, []
            yield made(batch, row_of, found)

    def made(batch: pa.RecordBatch, row_of: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 5
        arrays = [batch.column(0).take(pa.array(row_of, pa.int64())), *(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "chunk_index", "char_start", "char_end", "n_tokens", "text"])

    ints = ("chunk_index", "char_start", "char_end", "n_tokens")
    schema = StructType([StructField("doc", rows.schema["doc"].dataType), *[StructField(c, IntegerType()) for c in ints], StructField("text", StringType())])
    out = rows.mapInArrow(cut, schema)
    return out.select("doc", "chunk_index", chunk_id(F.col("doc"), F.col("chunk_index")).alias("chunk_id"), "char_start", "char_end", "n_tokens", "text")


def force_split(docs: DataFrame, most: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, part, n_tokens, text: windows of ``most`` tokens, however short the last."""
    cut = fixed_windows(docs, Limits(most, overlap, 0), id_col, text_col, clean=False)
    return cut.select("doc", F.col("chunk_index").alias("part"), "n_tokens", "text")


def is_header(line: Column) -> Column:
    wide = [h.replace(r"[A-Z\s]", f"[A-Z{SPACE}]").replace(r"\s", f"[{SPACE}]") for h in HEADERS]
    return strip(line).rlike("|".join(f"(?:{h})" for h in wide))


def sections(docs: DataFrame, least_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, nth, title, char_start, text of each section of ``least_chars`` at least.

    A header line begins a section if anything but blanks stands before it;
    so a document that begins with a header has a first section without title.
    """
    rows = docs.select(docs[id_col].alias("doc"), F.split(docs[text_col], "\n", -1).alias("lines"))
    lines = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"), (F.length(strip(x)) > 0).alias("some"), is_header(x).alias("header")))
    rows = rows.withColumn("l", lines)
    first = F.array_min(F.transform(F.filter("l", lambda x: x["some"]), lambda x: x["i"]))
    rows = rows.withColumn("first", first)
    heads = F.transform(F.filter("l", lambda x: x["header"] & (x["i"] > F.col("first"))), lambda x: x["i"])
    rows = rows.withColumn("at", F.concat(F.array(F.lit(0)), heads))
    cut = F.transform("at", lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get("at", k + 1), F.size("lines")).alias("e"), (k > 0).alias("titled")))
    part = lambda c: F.slice("lines", c["s"] + 1, c["e"] - c["s"])
    rows = rows.select("doc", F.transform(cut, lambda c: F.struct(F.array_join(part(c), "\n").alias("raw"), F.when(c["titled"], strip(F.get("lines", c["s"]))).alias("title"))).alias("c"))
    rows = rows.withColumn("starts", running(F.transform("c", lambda x: F.length(x["raw"]) + 1)))
    out = rows.select("doc", F.posexplode(F.arrays_zip("c", "starts")).alias("nth", "x"))
    return out.select("doc", "nth", F.col("x.c.title").alias("title"), F.col("x.starts").alias("char_start"), strip(F.col("x.c.raw")).alias("text")).where(F.length("text") >= least_chars)


def page_spans(text: Column) -> Column:
    """array<struct<page, start, end>>: each page to where the next marker begins."""
    marker = f"(?md){MARKER.replace(SPACE, SPACE.replace('x09-', 'x09' + chr(92) + 'x0B-'))}"  # within its line
    marks = F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    between = F.transform(F.split(text, marker, -1), F.length)
    gaps = F.slice(between, 1, F.size(marks))
    # a marker begins after the gaps up to its own and the markers before it
    before = running(F.zip_with(gaps, marks, lambda g, m: g + F.length(m)))
    sums = F.zip_with(before, gaps, lambda b, g: b + g)
    number = F.transform(marks, lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))
    # whole arrays side by side: an array looked up inside a lambda would be made again for each element
    ends = F.concat(F.slice(sums, 2, F.size(marks)), F.array(F.length(text) + 1))
    return F.transform(F.arrays_zip(number.alias("page"), sums.alias("start"), F.slice(ends, 1, F.size(marks)).alias("end")), lambda x: F.struct(x["page"].alias("page"), x["start"].alias("start"), x["end"].alias("end")))


def chunk_pages(chunks: DataFrame, pages: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """``on``, ``keep`` and ``pages`` of every chunk: the ascending distinct pages that its span overlaps.

    ``chunks`` has on, keep, char_start, char_end; ``pages`` has on, page, start,
    end.  Both are cut into bins as wide as a document's mean span, met bin by
    bin, and a pair counts in the bin in which the later of the two begins, so
    a document of very many pages is neither gathered nor compared pairwise.
    Spans without characters meet nothing; null bounds neither.
    """
    spans = lambda rows, a, e: rows.where(F.col(a) < F.col(e)).groupBy(*on).agg(F.sum((F.col(e) - F.col(a)).cast("long")).alias("chars"), F.count(F.lit(1)).alias("spans"))
    both = spans(chunks, "char_start", "char_end").unionAll(spans(pages, "start", "end"))
    width = both.groupBy(*on).agg(F.greatest(F.lit(1), F.max(F.ceil(F.col("chars") / F.col("spans")))).cast("long").alias("__w"))
    bins = lambda a, e: F.explode(F.sequence(F.floor(F.col(a) / F.col("__w")), F.floor((F.col(e) - 1) / F.col("__w")))).alias("__bin")
    c = chunks.where("char_start < char_end").join(width, on).select(*on, *keep, "char_start", "char_end", "__w", bins("char_start", "char_end"))
    p = pages.where("start < end").join(width, on).select(*on, "page", "start", "end", bins("start", "end"))
    met = c.join(p, [*on, "__bin"]).where((F.col("char_start") < F.col("end")) & (F.col("char_end") > F.col("start")) & (F.col("__bin") == F.floor(F.greatest("char_start", "start") / F.col("__w"))))
    found = met.groupBy(*on, *keep).agg(F.array_sort(F.collect_set("page")).alias("pages"))  # the pages of one chunk
    none = F.expr("cast(array() as array<int>)")
    return chunks.select(*on, *keep).join(found, [*on, *keep], "left").withColumn("pages", F.coalesce(F.col("pages").cast("array<int>"), none))


def pages_of(start: Column, end: Column, spans: Column) -> Column:
    """Ascending distinct pages that overlap [start, end)."""
    hits = F.filter(spans, lambda p: (start < p["end"]) & (end > p["start"]))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda p: p["page"])))


class Pages:
    """The pages of a raw text, from one pass over its lines."""

    def __init__(self, text: str) -> None:
        self.numbers, self.starts, at = [], [], 0
        for line in text.split("\n"):
            if m := _PAGE.match(line):
                self.numbers.append(int(m[1]))
                self.starts.append(at)
            at += len(line) + 1
        self.ends = [*self.starts[1:], at] if self.starts else []

    def over(self, start: int, end: int) -> list[int]:
        """Pages that [start, end) overlaps."""
        return sorted(set(self.numbers[bisect_right(self.ends, start) : bisect_left(self.starts, end)]))

    def first(self) -> list[int]:
        return self.numbers[:1]


class Chunk(NamedTuple):
    text: str
    title: str | None
    start: int
    end: int
    strategy: str
    pages: list[int]


def split_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.end()].strip():
            out.append(text[at : m.end()])
            at = m.end()
    return [*out, text[at:]] if text[at:].strip() else out


def pack_sentences(text: str, limits: Limits, always_overlap: bool, begin: int = 0, tokenise: Tokeniser = plain_tokens) -> list[tuple[str, int]]:
    """(chunk, its start): sentences added while they fit, then the overlap.

    A chunk below the least size is not kept.  Its last tokens open the next
    one if ``always_overlap``, or once a chunk was kept.
    """
    out: list[tuple[str, int]] = []
    held, held_tokens, start, at = "", 0, begin, begin

    def keep(chunk: str) -> None:
        if len(tokenise(chunk)) >= limits.least:
            out.append((chunk, start))

    for sentence in split_sentences(text):
        n = len(tokenise(sentence))
        if held and held_tokens + n > limits.size:
            chunk = held.strip()
            keep(chunk)
            if limits.overlap and (out or always_overlap):
                carried = "".join(tokenise(chunk)[-limits.overlap :])
                start += len(chunk) - len(carried)
                held = f"{carried} {sentence}"
                held_tokens = len(tokenise(held))
            else:
                start = start + len(chunk) if always_overlap else at
                held, held_tokens = sentence, n
        else:
            held += sentence
            held_tokens += n
        at += len(sentence)
    if held.strip():
        keep(held.strip())
    return out


def find_sections(text: str, least_chars: int) -> list[tuple[str, str | None, int, int]]:
    """(text, title, start, end), as ``sections`` does it."""
    found, lines, at, begun, title, some = [], [], 0, 0, None, False
    for line in [*text.split("\n"), None]:
        ends = line is None or (some and _HEADER.match(line.strip()))
        if ends:
            whole = "\n".join(lines).strip()
            if whole and len(whole) >= least_chars:
                found.append((whole, title, begun, at))
            if line is None:
                break
            lines, begun, title = [], at, line.strip()
        lines.append(line)
        some = some or bool(line.strip())
        at += len(line) + 1
    return found or [(text, None, 0, len(text))]


def split_tokens(text: str, most: int, overlap: int, tokenise: Tokeniser = plain_tokens) -> list[str]:
    all_ = tokenise(text)
    step = most - overlap if overlap < most else most
    return ["".join(all_[k : k + most]) for k in range(0, len(all_), step)]


def _clean(text: str) -> str:
    text = re.sub(r"(?m)^--- Page \d+ ---\s*$", "", text)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def by_sentences(text: str, limits: Limits, pages: Pages, tokenise: Tokeniser = plain_tokens) -> list[Chunk]:
    return [Chunk(c, None, s, s + len(c), "sentence", pages.over(s, s + len(c))) for c, s in pack_sentences(_clean(text), limits, False, 0, tokenise)]


def by_structure(text: str, limits: Limits, pages: Pages, tokenise: Tokeniser = plain_tokens) -> list[Chunk]:
    """One chunk a section; parts of a section above the most tokens have its place and the first page."""
    out = []
    for body, title, start, end in find_sections(_clean(text), limits.least):
        n = len(tokenise(body))
        if n > limits.most:
            loose = Limits(limits.size, limits.overlap, 0, limits.most)
            for chunk, _ in pack_sentences(body, loose, True, 0, tokenise):
                parts = split_tokens(chunk, limits.most, limits.overlap, tokenise) if len(tokenise(chunk)) > limits.most else [chunk]
                out += [Chunk(p.strip(), title, start, end, "structure", pages.first()) for p in parts if len(tokenise(p.strip())) >= limits.least]
        elif n >= limits.least:
            out.append(Chunk(body, title, start, end, "structure", pages.over(start, end)))
    return out


def by_hybrid(text: str, limits: Limits, pages: Pages, tokenise: Tokeniser = plain_tokens) -> list[Chunk]:
    """Sections, those above the size by sentences; without several sections or any chunk, sentences."""
    found, out = find_sections(_clean(text), limits.least), []
    if len(found) > 1:
        for body, title, start, end in found:
            n = len(tokenise(body))
            if limits.least <= n <= limits.size:
                out.append(Chunk(body, title, start, end, "hybrid", pages.over(start, end)))
            elif n > limits.size:
                out += [Chunk(c, title, s, s + len(c), "hybrid", pages.over(s, s + len(c))) for c, s in pack_sentences(body, limits, True, start, tokenise)]
    return out or by_sentences(text, limits, pages, tokenise)


def by_size(text: str, limits: Limits, pages: Pages, tokenise: Tokeniser = plain_tokens) -> list[Chunk]:
    all_, out, at = tokenise(_clean(text)), [], 0
    for k in range(0, len(all_), limits.step):
        part = all_[k : k + limits.size]
        if k and len(part) < limits.least:
            break
        chunk = "".join(part)
        out.append(Chunk(chunk, None, at, at + len(chunk), "fixed", pages.over(at, at + len(chunk))))
        at += sum(map(len, all_[k : k + limits.step]))
        if len(all_) < limits.least:
            break
    return out


STRATEGIES = {"fixed": by_size, "sentence": by_sentences, "structure": by_structure, "hybrid": by_hybrid}


def create_chunks(text: str, strategy: str, limits: Limits, tokenise: Tokeniser = plain_tokens) -> list[Chunk]:
    """The first strategy that gives chunks, the named one first; none above the most tokens."""
    pages = Pages(text)
    for name in dict.fromkeys([strategy, "hybrid", "sentence", "fixed"]):
        if found := STRATEGIES[name](text, limits, pages, tokenise):
            out = []
            for chunk in found:
                if len(tokenise(chunk.text)) <= limits.most:
                    out.append(chunk)
                else:
                    out += [chunk._replace(text=p, end=chunk.start + len(p)) for p in split_tokens(chunk.text, limits.most, limits.overlap, tokenise)]
            return out
    return []


CHUNKS = "doc string, chunk_index int, chunk_id string, strategy string, title string, char_start int, char_end int, n_tokens int, text string, pages array<int>"


def _attempted(batches: Iterator[pa.RecordBatch], strategy: str, limits: Limits, tokenise: Tokeniser) -> Iterator[pa.RecordBatch]:
    """Rows of ``attempts`` of batches of doc, text; a text is held at a time, and not much more than ``_OUT_CHARS`` of chunks."""
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in CHUNKS.split(", ")), "error"])

    for batch in batches:
        rows, held = [], 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc, text = doc.as_py(), text.as_py()
            blank = not (text or "").strip()
            found = [] if blank else create_chunks(text, strategy, limits, tokenise)
            for i, c in enumerate(found):
                rows.append((doc, i, f"{doc}_chunk_{i:04d}", c.strategy, c.title, c.start, c.end, len(tokenise(c.text)), c.text, c.pages, None))
                held += len(c.text)
                if held > _OUT_CHARS:
                    yield made(rows)
                    rows, held = [], 0
            if not found:
                rows.append((doc, *[None] * 9, "Empty text file" if blank else "No chunks"))
        yield made(rows)


def attempts(docs: DataFrame, strategy: str = "hybrid", limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", tokenise: Tokeniser = plain_tokens) -> DataFrame:
    """The columns of ``CHUNKS``, and of a document without chunks one row of nulls with its error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _attempted(batches, strategy, limits, tokenise)

    return docs.select(docs[id_col].cast("string").alias("doc"), docs[text_col].cast("string").alias("text")).mapInArrow(run, CHUNKS + ", error string")


def chunks(docs: DataFrame, strategy: str = "hybrid", limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", tokenise: Tokeniser = plain_tokens) -> DataFrame:
    """The chunks of every document; one without text or chunks gives none."""
    return attempts(docs, strategy, limits, id_col, text_col, tokenise).where("error is null").drop("error")


def statuses(attempted: DataFrame) -> DataFrame:
    """doc, status, n_chunks, error of ``attempts``: a blank document, or one without chunks, failed."""
    by = attempted.groupBy("doc").agg(F.count("chunk_index").alias("n_chunks"), F.max("error").alias("error"))
    return by.select("doc", F.when(F.col("n_chunks") > 0, "SUCCESS").otherwise("FAILED").alias("status"), "n_chunks", F.when(F.col("n_chunks") == 0, F.col("error")).alias("error"))
