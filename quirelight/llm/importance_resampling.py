"""Importance resampling of documents towards a target's words.

Features are all runs of one and two consecutive words, hashed into buckets
(crc32 modulo ``BUCKETS``).  A bucket's gain is the logarithm of how much more
often the target holds it than the documents do, in thousandths; a document's
weight is the floored mean of its features' gains.  With Gumbel noise drawn
from a hash of its id, the documents of highest score are a draw without
replacement in which weights act as probabilities.

The k-th highest score is found exactly by radix selection: the key (score,
then smaller doc_id) is cut into digits of 16 bits; each pass counts the rows
of one digit among those that agree with the digits found so far, so a pass
brings 65,536 counts at most to the driver, whatever the table.  Only rows up
to that key are range-sorted and ranked.  Rows equal in all that the result
shows are counted before they move, so copies never gather in a task.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased: runs
of digits, letters a-z and all that is not ASCII.

Defined results: null and empty texts, and texts without words, have no
features and weight 0; such rows, and those under ``min_words`` words, are
never drawn and have a null rank.  A null doc_id hashes as an empty one and
comes after all ids.  Rows with equal score and id are ordered by n_features,
then weight; rows equal in these too cannot be told apart, and the first of
them get the ranks that are left.  Repeated rows count in all sums and are
each a row of the result.  Without target texts every gain compares with an
empty table (T = t = 0); an empty table of documents gives an empty result.
Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import dropped, partitions, written

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
_DIGIT = 16  # bits of the key that one pass counts
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def feature_hashes(text: bytes | None) -> tuple[int, list[int]]:
    """The number of words, and crc32 of each feature's bytes."""
    words = _WORD.findall((text or b"").translate(_LOWER))
    single = list(map(zlib.crc32, words))
    # crc32 goes on from the first word's value, so no pair is built
    return len(words), single + list(map(zlib.crc32, [b" " + w for w in words[1:]], single))


def _buckets(text: bytes | None, buckets: int) -> tuple[int, np.ndarray]:
    n, hashes = feature_hashes(text)
    return n, np.array(hashes, np.int64) % buckets


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds: one row a bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                got = _buckets(text.as_py(), buckets)[1]
                if len(got):
                    held += np.bincount(got, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["bucket", "n"])

    texts = table.select(table[text_col].cast("string").cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = [(t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 4), np.int64)
            for i, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                n, got = _buckets(text.as_py(), len(table))
                weight = int(table[got].sum()) // len(got) if len(got) else 0
                out[i] = n, len(got), weight, weight + noise(doc_id.as_py(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(4))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(score, _SCORED)


def _digits(c: Column) -> list[Column]:
    """A long as four digits of 16 bits whose order is that of the numbers."""
    turned = c.bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)) for shift in (48, 32, 16, 0)]


def radix_select(rows: DataFrame, keys: list[Column], k: int) -> tuple[list[int], int]:
    """The k-th least key of ``rows`` (k from 1), as digits, and how many rows with just that key are among the k.

    ``keys`` are longs, compared in turn.  Each pass is one job over the rows
    that agree with the digits found, and brings a count a digit at most; a
    digit in which all of these agree takes no pass (their range shows it).
    """
    digits = [d for key in keys for d in _digits(key)]
    named = rows.select(*[d.cast("int").alias(f"d{i}") for i, d in enumerate(digits)])
    prefix: list[int] = []
    while len(prefix) < len(digits):
        here = named
        for i, d in enumerate(prefix):
            here = here.where(F.col(f"d{i}") == d)
        if len(prefix) % 4 == 0:  # a new key: which of its digits are the same in all rows
            ends = here.agg(*[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(len(prefix), len(prefix) + 4) for f in (F.min, F.max)]).first()
        i = len(prefix)
        if ends[f"min{i}"] == ends[f"max{i}"]:
            prefix.append(ends[f"min{i}"])
            continue
        for digit, n in sorted(map(tuple, here.groupBy(f"d{i}").agg(F.count(F.lit(1)).alias("n")).collect())):  # 65,536 rows at most
            if k <= n:
                prefix.append(digit)
                break
            k -= n
    return prefix, k


def _compare(digits: list[Column], prefix: list[int]) -> tuple[Column, Column]:
    """Whether a key is below, and whether it is the one of ``prefix``."""
    below, same = F.lit(False), F.lit(True)
    for d, p in zip(digits, prefix, strict=True):
        below, same = below | (same & (d < p)), same & (d == p)
    return below, same


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows, _ = written(scored(docs, gain, seed, id_col, text_col))  # five numbers a row, read again by each pass
    return ranked(rows, rows.where(F.col("n_words") >= min_words).count() * percent // 100, F.col("n_words") >= min_words)


def ranked(rows: DataFrame, k: int, eligible: Column) -> DataFrame:
    """``rows`` (those of ``scored``, stored) with rank 1 to k by falling score, smaller doc_id first."""
    nothing = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return rows.select("*", nothing)
    # falling order: the key grows as the score falls; a null id comes last
    keys = [F.bitwise_not("score"), F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"), F.coalesce("doc_id", F.lit(0))]
    prefix, _ = radix_select(rows.where(eligible), keys, k)
    below, same = _compare([d for key in keys for d in _digits(key)], prefix)
    drawn = eligible & (below | same)
    # equal rows are counted where they are; one row of each kind is sorted
    kinds = rows.where(drawn).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each kind with the number of rows before it in its range."""
        past = 0
        for batch in batches:
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            ends = np.cumsum(copies) + past
            past = int(ends[-1]) if len(ends) else past
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - copies, pa.int64())], names=[*batch.schema.names, "before"])

    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    dealt = kinds.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    sorted_kinds, path = written(dealt.mapInArrow(placed, f"{types}, before long"))
    totals = sorted_kinds.groupBy("range").agg(F.sum("copies").alias("total"))  # a row a range
    offsets = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("offset"))
    first = F.col("offset") + F.col("before") + 1
    # of the rows that share the k-th key only the first are drawn
    ranks = F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("rank")
    numbered = sorted_kinds.join(F.broadcast(offsets), "range").select(*rows.columns, ranks)
    taken = numbered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return taken.unionAll(rows.where(~drawn).select("*", nothing))
