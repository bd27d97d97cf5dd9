"""Transcripts: parts that fit a model, cleaned in turn, with a guard against summaries.

A part is a span of the raw text between two places where it may be cut; the
spans are found from offsets alone and a text is copied only when a part is
handed to the model.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Store
from .chunking import Tokeniser, plain_tokens

LEAST_SHARE, CONTEXT, SEGMENT = 0.5, 600, 6000
Clean = Callable[[str, int, int, str | None], str]  # (part, its number, their number, end of the cleaned part before)
# where a text may be cut, the better place first: before a paragraph, before a sentence
_CUTS = (re.compile(r"\n\s*\n\s*"), re.compile(r"(?<=[.!?])\s+"))


def spans(text: str, most: int = SEGMENT, tokenise: Tokeniser = plain_tokens) -> list[tuple[int, int]]:
    """(start, end) of parts of ``most`` tokens at most, in order.

    From each start the part reaches to the last paragraph that still fits,
    else to the last sentence that does; a sentence too long for itself alone
    is a part as it is.
    """
    ends = list(accumulate(map(len, tokenise(text))))
    if len(ends) <= most:
        return [(0, len(text))] if text else []
    places = [[*(m.end() for m in cut.finditer(text) if 0 < m.end() < len(text)), len(text)] for cut in _CUTS]
    upto = [[bisect_right(ends, p) for p in kind] for kind in places]  # tokens before each place
    out, at = [], 0
    while at < len(text):
        room = bisect_right(ends, at) + most
        fits = (kind[i - 1] for kind, counts in zip(places, upto, strict=True) if (i := bisect_right(counts, room)) and kind[i - 1] > at)
        to = next(fits, None) or min(kind[bisect_right(kind, at)] for kind in places)
        out.append((at, to))
        at = to
    return out


def segments(text: str, most: int = SEGMENT, tokenise: Tokeniser = plain_tokens) -> list[str]:
    """The texts of the parts, without white space at their ends; blank ones are none."""
    return [part for a, b in spans(text, most, tokenise) if (part := text[a:b].strip())]


def carried(parts: list[str], clean: Clean) -> str:
    """The parts cleaned one after another, each told how the one before ended."""
    done, tail = [], None
    for k, part in enumerate(parts):
        done.append(clean(part, k, len(parts), tail))
        tail = done[-1][-CONTEXT:]
    return "\n\n".join(x for x in done if x)


def kept_enough(raw: Column, clean: Column, least: float = LEAST_SHARE) -> Column:
    """Whether a cleaned text keeps enough of the raw one; an empty raw text is kept."""
    return F.when(F.length(raw) == 0, True).otherwise(F.length(clean) / F.length(raw) >= least)


def clean_all(docs: DataFrame, clean: Clean, id_col: str, text_col: str, most: int = SEGMENT, tokenise: Tokeniser = plain_tokens, least: float = LEAST_SHARE) -> DataFrame:
    """doc, segments, text, error of every transcript.

    A model that fails, or a result shorter than ``least`` of the raw text,
    leaves the document without a text and with the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts, failures = [], [], []
            for raw in batch.column(1):
                parts = segments(raw.as_py(), most, tokenise)
                counts.append(len(parts))
                try:
                    texts.append(carried(parts, clean))
                    failures.append(None)
                except Exception as e:  # a model's failure is the document's status
                    texts.append(None)
                    failures.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(failures, pa.string())], names=["doc", "raw", "segments", "made", "failure"])

    rows = docs.select(docs[id_col].cast("string").alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("raw"))
    made = rows.mapInArrow(run, "doc string, raw string, segments int, made string, failure string")
    whole = kept_enough(F.col("raw"), F.col("made"), least)
    short = F.concat(F.lit("too short: "), F.length("made").cast("string"), F.lit(" of "), F.length("raw").cast("string"), F.lit(" characters are left"))
    return made.select("doc", F.greatest("segments", F.lit(1)).alias("segments"), F.when(whole, F.col("made")).alias("text"), F.coalesce("failure", F.when(~whole, short)).alias("error"))


def publish(cleaned: DataFrame, store: Store, details: DataFrame | None = None, key: str = "doc") -> int:
    """Cleaned transcripts that the store lacks, with their details, as one change of two tables; how many.

    Table ``texts`` has the cleaned texts and ``records`` a JSON document each
    (details by ``key``, and the length); both lie in buckets of the key, and a
    transcript that failed is tried again by the next run.
    """
    new = cleaned.where("text is not null").select(key, "text")
    if store.exists("texts"):
        new = new.join(store.beside("texts", new.select(key)).select(key), key, "left_anti")
    new = new.persist()
    try:
        described = new if details is None else new.join(details, key, "left")
        fields = [c for c in described.columns if c != "text"]
        with store.begin() as t:
            t.append("texts", new, key)
            t.append("records", described.select(key, F.to_json(F.struct(*fields, F.length("text").alias("n_chars"))).alias("record")), key)
        return new.count()
    finally:
        new.unpersist()
