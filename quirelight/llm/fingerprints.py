"""Document fingerprints: one-permutation MinHash with optimal densification.

Each distinct five-word shingle is hashed once.  The high bits of the hash
name one of ``BINS`` bins and a bin keeps its smallest hash.  An empty bin
takes the value of a non-empty bin found by its own sequence of hashed probes
(the same sequence for every document), hashed once more with the bin's number
so that bins which borrow one value agree or differ each for itself, and the low ``BITS`` bits of each bin
are packed into the fingerprint.  Likeness is the share of equal bins, less
what chance alone would give: ``(m - 2^-b) / (1 - 2^-b)``, held to 0..1.

Defined results: null texts are empty; the fingerprint of a text without
words is the empty string, which is like another empty one (1.0) and unlike
all else (0.0).  Repeated rows each give a row.  Rows are ordered by
descending doc_id, null ids last, ties by descending text (null before empty
makes no difference, both are empty); the next of the last row is the first;
a lone document is next to itself.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept, partitions
from .text_hash import U, chunks, mix, shingle_hashes, texts_of, word_hashes

BINS, BITS = 512, 4
PARTS = 64  # of the rows of ids that very many rows repeat
_EMPTY = np.iinfo(np.uint64).max
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@functools.cache
def _probes(bins: int, attempt: int) -> np.ndarray:
    """The bin that each empty bin looks at in this attempt; in attempt 0 what a borrowed value is hashed with."""
    own = np.arange(bins, dtype=U)
    return mix(own + U(1)) if attempt == 0 else (mix(own * U(0x9E3779B97F4A7C15) + U(attempt)) % U(bins)).astype(np.int64)


def _densified(table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row; rows that are all empty stay so."""
    full = table != _EMPTY
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    out, size = table.copy(), table.shape[1]
    attempt = 0
    while len(rows):
        attempt += 1
        probe = _probes(size, attempt).take(bins)
        hit = full[rows, probe]
        # hashed with the bin, else one borrowed value would decide all the low bits of a short text
        out[rows[hit], bins[hit]] = mix(table[rows[hit], probe[hit]] ^ _probes(size, 0).take(bins[hit]))
        rows, bins = rows[~hit], bins[~hit]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of BINS * BITS / 8 bytes and a flag byte (1: no words) a text."""
    raw, offsets = texts_of(column)
    n, shift = len(offsets) - 1, U(64 - (BINS - 1).bit_length())
    out = np.zeros((n, BINS * BITS // 8 + 1), np.uint8)
    for a, b in chunks(offsets):
        sh, have = shingle_hashes(*word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        table = np.full((b - a) * BINS, _EMPTY, U)
        np.minimum.at(table, np.repeat(np.arange(b - a), have) * BINS + (sh >> shift).astype(np.int64), sh)
        table = _densified(table.reshape(b - a, BINS))
        low = (table & U((1 << BITS) - 1)).astype(np.uint8)
        per = 8 // BITS
        packed = np.zeros((b - a, BINS // per), np.uint8)
        for k in range(per):
            packed |= low[:, k::per] << np.uint8(k * BITS)
        out[a:b, :-1] = packed
        out[a:b, -1] = have == 0
    out[out[:, -1] == 1, :-1] = 0
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias-corrected share of equal bins, row by row."""
    differ, same = x[:, :-1] ^ y[:, :-1], np.zeros(len(x))
    mask = np.uint8((1 << BITS) - 1)
    for k in range(8 // BITS):
        same += ((differ >> np.uint8(k * BITS)) & mask == 0).sum(axis=1)
    chance = 2.0**-BITS
    out = np.clip((same / BINS - chance) / (1 - chance), 0, 1)
    either = (x[:, -1] == 1) | (y[:, -1] == 1)
    return np.where(either, ((x[:, -1] == 1) & (y[:, -1] == 1)).astype(float), out)


def _hex(prints: np.ndarray) -> list[str]:
    return ["" if row[-1] else row[:-1].tobytes().hex() for row in prints]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; ghosts repeat the next range's first."""
    held: tuple | None = None  # (range, id, ghost, text, print) of the row before
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = [x or "" for x in part.column(3).to_pylist()]
            keys, ids, ghosts = (part.column(k).to_pylist() for k in range(3))
            prints = fingerprints(part.column(3))
            rows = list(zip(keys, ids, ghosts, texts, prints, strict=True))
            chain = ([held] if held else []) + rows
            pairs = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if x[0] == y[0] and not x[2]]
            held = rows[-1]
            if not pairs:
                continue
            changed = [edited(x[3], y[3]) for x, y in pairs]
            own, after = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
            other = fingerprints(pa.array(changed, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[1] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(_hex(own)),
                    pa.array(_hex(other)),
                    pa.array(likeness(own, other)),
                    pa.array(likeness(own, after)),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edit and its successor: one range shuffle.

    Rows are dealt to ranges of doc_id whose bounds are approximate quantiles
    (a fixed few thousand numbers).  An id (null is one) that more rows repeat
    than a range should hold is a range of its own, cut further by the first
    bytes of the texts.  The first row of each range is repeated at the end of
    the range before it, so that no window spans ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    n = partitions(spark) * 4
    cuts = rows.select(F.col("doc_id").cast("double").alias("x")).where("x is not null").approxQuantile("x", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    counts = kept(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    total = rows.count()
    heavy = {r.doc_id for r in counts.where(F.col("c") > max(PARTS, total // n)).collect()}  # n at most
    numbers = {min(int(c), (1 << 63) - 1) for c in cuts} | {h + k for h in heavy if h is not None for k in (0, 1) if h + k < 1 << 63}
    bounds = F.array(*[F.lit(b) for b in sorted(numbers)]) if numbers else F.expr("cast(array() as array<bigint>)")
    # range 0 holds the largest ids, the last range the null ids; in ranges of one id the largest texts are first
    place = F.when(F.col("doc_id").isNull(), F.lit(len(numbers) + 1)).otherwise(F.size(F.filter(bounds, lambda b: b > F.col("doc_id"))))
    part = F.lit(0)
    if heavy:
        many = F.col("doc_id").isin([h for h in heavy if h is not None])
        many = many | F.col("doc_id").isNull() if None in heavy else many
        begins = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
        marks = sorted(set(rows.where(many).select(begins.alias("x")).approxQuantile("x", [k / PARTS for k in range(1, PARTS)], 0.25 / PARTS)))
        part = F.when(F.coalesce(many, F.lit(None in heavy)), F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m > begins))).otherwise(0)
    placed = rows.withColumn("r", (place.cast("long") * PARTS + part).cast("long"))
    tops = kept(placed.groupBy("r").agg(F.max("doc_id").alias("top")))
    found = [(x.r, x.top) for x in tops.orderBy("r").collect()]  # one row a range
    if not found:
        return spark.createDataFrame([], SCHEMA)
    # of each range the first row in order: its largest id, then its largest text
    before = {r: found[i - 1][0] if i else found[-1][0] for i, (r, _) in enumerate(found)}
    named = spark.createDataFrame([(r, top, before[r]) for r, top in found], "r long, top long, to long")
    firsts = placed.join(F.broadcast(named), "r").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("to").agg(F.max("text").alias("text"))
    ghosts = firsts.select(F.col("to").alias("r"), F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("ghost"), "text")
    every = placed.select("r", "doc_id", F.lit(False).alias("ghost"), "text").unionByName(ghosts)
    dealt = every.repartition("r").sortWithinPartitions("r", "ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    return dealt.mapInArrow(_compare, SCHEMA)
