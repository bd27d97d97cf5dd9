"""Periodic runs of words: all lags of a document, scanned as arrays.

A document's words (``[^\\x20\\x09-\\x0D]+``, case kept) get ids, and for each
lag p the id array is compared with itself shifted by p: a stretch of L equal
places is a run of L + p words with period p.  Only stretches of at least
``m = max(least - p, (min_exp - 1) * p)`` places matter, and such a stretch
holds one of the places m-1, 2m-1, ... of its lag.  So the lags are compared
at these places first, many lags in one array operation (by hashes of a few
consecutive ids, n ln n places for all lags together), and the stretches around
the places found equal are run-length coded from the ids themselves: whole
when a lag has many such places, else outwards from each.  Every lag is
scanned; nothing is skipped but places inside a run already known whose period
divides the lag, where the lag's stretch is that same run.

A document whose scan takes more than ``work`` places is dealt out: each row
of (document, range of lags) is scanned by any task, and the runs of a
document's ranges meet again for the result.  Ranges need nothing of each
other, as a run of a multiple of its period is reduced to its least period.

Result: one row a document with ``doc_id``, ``n_words``, ``runs`` (start,
length, period; by start, then period) and ``collapsed``, the words left when
of each run only the first period stays, joined by one space.

Defined results: null and empty texts have no words, no runs and an empty
collapsed text; a document with fewer than ``least`` words has no runs; rows
that repeat an id and a text each give the same row; ids may be null; columns
other than the two named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MIN_EXP = 12, 2  # words of a run, and how often its period fits
WORK = 1 << 21  # places of a document that one task compares
LONG_BYTES = 1 << 18  # texts up to here are scanned where they are read, whatever their work
_BLOCK = 1 << 16  # places compared in one array operation
_OUT_BYTES = 1 << 22
Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_PARTS = "doc_id long, digest binary, copies long, part int, text binary, found binary"


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten (by crc32 of its id) with its tail made periodic.

    With h the crc32 and g = h // 10, each word i from a = g % n on becomes
    word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8).  Documents
    without an id stay as they are.
    """
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class Scan:
    """The runs of one document's ids, by ranges of lags."""

    def __init__(self, ids: np.ndarray, least: int = LEAST, min_exp: int = MIN_EXP) -> None:
        if least < 2 or min_exp < 2:
            raise ValueError("runs need two words and two periods at least")
        self.ids, self.n, self.least = ids, len(ids), least
        self.lags = np.arange(1, self.n // min_exp + 1)
        self.need = np.maximum(least - self.lags, (min_exp - 1) * self.lags)
        self.width = min(int(self.need.min()), 8) if len(self.lags) else 1
        self.step = self.need - self.width + 1
        self.places = np.maximum(self.n - self.lags - self.width + 1, 0) // self.step

    def ranges(self, work: int) -> list[tuple[int, int]]:
        """Lags [lo, hi) of about ``work`` places each; a lag is never cut."""
        before = np.concatenate([[0], np.cumsum(self.places)])
        cuts = np.searchsorted(before, np.arange(work, before[-1], work), side="left")
        marks = sorted({0, len(self.lags), *cuts.tolist()})
        return [(int(a) + 1, int(b) + 1) for a, b in zip(marks, marks[1:], strict=False)]

    def runs(self, lo: int = 1, hi: int | None = None) -> set[Run]:
        hi = len(self.lags) + 1 if hi is None else hi
        found: set[Run] = set()
        if self.n < self.least or hi <= lo:
            return found
        gram = np.zeros(self.n - self.width + 1, np.uint64)
        for k in range(self.width):  # equal ids have equal hashes; the ids decide
            gram = gram * np.uint64(0x9E3779B97F4A7C55) + self.ids[k : k + len(gram)].astype(np.uint64)
        for a, b in Scan._blocks(self.places[lo - 1 : hi - 1], _BLOCK):
            lags, places = self.lags[lo - 1 + a : lo - 1 + b], self.places[lo - 1 + a : lo - 1 + b]
            lag = np.repeat(lags, places)
            nth = np.arange(len(lag)) - np.repeat(np.cumsum(places) - places, places) + 1
            at = nth * np.repeat(self.step[lo - 1 + a : lo - 1 + b], places) - 1
            hit = np.flatnonzero(gram[at] == gram[at + lag])
            if len(hit):
                self._around(lag[hit], at[hit], found)
        return found

    @staticmethod
    def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield a, b
            a = b

    def _around(self, lag: np.ndarray, at: np.ndarray, found: set[Run]) -> None:
        """Add the runs whose stretches hold the places ``at`` of the lags."""
        lag, at = self._open(lag, at, found)
        while len(lag):
            p = int(lag[0])
            own = int(np.searchsorted(lag, p, side="right"))
            new = {self._least(a, e, p) for a, e in self._stretches(p, at[:own]) if e - a >= self.need[p - 1]}
            lag, at = lag[own:], at[own:]
            if new - found:
                lag, at = self._open(lag, at, new - found)
                found |= new

    @staticmethod
    def _open(lag: np.ndarray, at: np.ndarray, runs: set[Run]) -> tuple[np.ndarray, np.ndarray]:
        """Places outside the runs whose periods divide their lags."""
        for start, length, period in runs:
            if len(lag) and length >= lag[0]:
                stay = (at < start) | (at + lag > start + length) | (lag % period != 0)
                lag, at = lag[stay], at[stay]
        return lag, at

    def _stretches(self, p: int, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """[a, e) of equal places of lag p around each place."""
        ids, n = self.ids, self.n - p
        if len(at) > 8 + n // 4096:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:n] == ids[p:], [False]]).astype(np.int8)))
            yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
            return
        past = 0
        for j in at.tolist():
            if j >= past:
                a, past = self._reach(p, j, -1), self._reach(p, j, 1)
                yield a, past

    def _reach(self, p: int, j: int, way: int) -> int:
        """Where the stretch around j begins (way -1) or ends (way 1)."""
        ids, n, size = self.ids, self.n - p, 32
        while 0 < j if way < 0 else j < n:
            if way < 0:
                lo = max(0, j - size)
                differ = (ids[lo:j] != ids[lo + p : j + p])[::-1]
            else:
                differ = ids[j : min(n, j + size)] != ids[j + p : min(n, j + size) + p]
            k = int(differ.argmax())
            if differ[k]:
                return j - k if way < 0 else j + k
            j, size = j + way * len(differ), size * 2
        return j

    def _least(self, a: int, e: int, p: int) -> Run:
        """The run of a stretch with its least period, which divides p."""
        block = self.ids[a : a + p]
        for q in range(1, p // 2 + 1):
            if p % q == 0 and block[0] == block[q] and np.array_equal(block[q:], block[:-q]):
                return a, e + p - a, q
        return a, e + p - a, p


def collapsed(words: list[bytes], runs: set[Run]) -> bytes:
    """The words that no run drops, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


class _Out:
    """Result rows, a few megabytes a batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, words: list[bytes], runs: set[Run]) -> None:
        text = collapsed(words, runs)
        ordered = [dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(runs, key=lambda r: (r[0], r[2]))]
        self.rows.append((doc_id, len(words), ordered, text))
        self.held += len(text) + 24 * len(runs)

    def full(self) -> bool:
        return self.held > _OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        ids, sizes, runs, texts = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        self.rows, self.held = [], 0
        arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])


def _words(doc_id: int | None, text: bytes | None, edit: Edit | None) -> list[bytes]:
    words = (text or b"").split()  # bytes split at 0x20 and 0x09-0x0D
    return edit(doc_id, words) if edit else words


def find_runs(docs: DataFrame, least: int = LEAST, min_exp: int = MIN_EXP, edit: Edit | None = None, work: int = WORK, long_bytes: int = LONG_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every document; ``edit`` changes its words before."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = _words(doc_id.as_py(), text.as_py(), edit)
                out.add(doc_id.as_py(), words, Scan(word_ids(words), least, min_exp).runs() if len(words) >= least else set())
                if out.full():
                    yield out.batch()
        yield out.batch()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range of lags; the first carries the text on."""
        for batch in batches:
            for row in batch.to_pylist():
                ranges = Scan(word_ids(_words(row["doc_id"], row["text"], edit)), least, min_exp).ranges(work) or [(1, 1)]
                for k, (lo, hi) in enumerate(ranges):
                    marks = np.array([lo, hi], np.int64).tobytes()
                    yield pa.RecordBatch.from_pylist([row | {"part": k, "found": marks}], schema=_arrow)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi = np.frombuffer(row["found"], np.int64).tolist()
                runs = Scan(word_ids(_words(row["doc_id"], row["text"], edit)), least, min_exp).runs(lo, hi)
                blob = np.array(sorted(runs), np.int64).tobytes()
                yield pa.RecordBatch.from_pylist([row | {"text": None if row["part"] else row["text"], "found": blob}], schema=_arrow)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by document; its first part is the first of them."""
        out, key, held, runs = _Out(), None, None, set()

        def done() -> Iterator[pa.RecordBatch]:
            words = _words(held["doc_id"], held["text"], edit)
            for _ in range(held["copies"]):
                out.add(held["doc_id"], words, least_periods(runs))
                if out.full():
                    yield out.batch()

        for batch in batches:
            for row in batch.to_pylist():
                if held is None or (row["doc_id"], row["digest"]) != key:
                    if held is not None:
                        yield from done()
                    held, runs, key = row, set(), (row["doc_id"], row["digest"])
                runs |= set(map(tuple, np.frombuffer(row["found"], np.int64).reshape(-1, 3).tolist()))
        if held is not None:
            yield from done()
        yield out.batch()

    _arrow = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("copies", pa.int64()), ("part", pa.int32()), ("text", pa.binary()), ("found", pa.binary())])
    short = rows.where(~large).mapInArrow(whole, SCHEMA)
    # equal rows are one document here, combined before the shuffle
    once = rows.where(large).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    parts = once.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", F.lit(0).alias("part"), "text", F.lit(b"").alias("found")).mapInArrow(dealt, _PARTS)
    results = parts.repartition("doc_id", "digest", "part").mapInArrow(scanned, _PARTS)
    merged = results.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "part").mapInArrow(joined, SCHEMA)
    return short.unionAll(merged)


def least_periods(runs: set[Run]) -> set[Run]:
    """Of runs over the same words, the one of least period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        best[start, length] = min(period, best.get((start, length), period))
    return {(*span, period) for span, period in best.items()}
