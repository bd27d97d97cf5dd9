"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the largest length are cut into pieces.  Pieces go, the
largest first, to the open bin with the least room that still holds them.  If
none does, a bin is opened.  A sequence of c tokens costs c, OVERHEAD, and
c * c / ATTENTION for attention, whose share grows with the length.  For each
length that holds the piece, the bin is filled in thought with the largest of
the pieces still to come that fit, and the length is opened whose contents,
downsized to the least length that holds them, cost least a token.  At last
each bin is downsized to its contents.  As what is cheapest for one bin may
leave dear rests, a group is packed so with every choice of lengths to open
(the largest always among them) and the packing of least cost holds.

Rows are dealt to groups of about ``GROUP`` documents by a hash of the row, so
groups are independent tasks and their number follows the input.  A group that
repeated rows make larger is packed in runs of at most ``4 * GROUP`` pieces,
which bounds memory without losing a row.

Defined results: a document without tokens (null or empty text) is one piece
of 0 tokens and takes a place in a bin; repeated rows are packed each for
itself; ties go to the smaller id, null ids first; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
ATTENTION = 24_576  # attention costs as much as all else at this length, 6 times a width of 4096
GROUP = 20_000
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id string, bin_tokens long, bin_capacity long, bin_offset long"


def cost_of(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> int:
    """The cost of a sequence, as a whole number of 1/attention tokens."""
    return (length + overhead) * attention + length * length


def _opened(size: int, lengths: tuple[int, ...], left: int, counts: list[int], costs: dict[int, int]) -> int:
    """The length to open for a piece; ``left`` has bit s set if ``counts[s]`` pieces of s are to come."""
    best = None
    for length in lengths:
        if length < size:
            continue
        room = limit = length - size
        while fits := left & ((1 << limit + 1) - 1):
            s = fits.bit_length() - 1
            room -= s * min(counts[s], room // s)
            limit = min(room, s - 1)
        used = length - room
        cost = next(v for c, v in costs.items() if c >= used)
        # the least cost a token, and of equals the longest
        if best is None or cost * best[1] <= best[0] * used:
            best = cost, used, length
        if not used:
            break
    return best[2]


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, contents, capacity of each bin) of least cost; sizes descend."""
    lengths, best = tuple(sorted(lengths)), None
    costs = {c: cost_of(c, overhead, attention) for c in lengths}
    for few in range(len(lengths)):
        for some in combinations(lengths[:-1], few):
            of, used = _fill(sizes, (*some, lengths[-1]), costs)
            capacities = [next(c for c in lengths if c >= n) for n in used]
            cost = sum(costs[c] for c in capacities)
            if best is None or cost < best[0]:
                best = cost, of, used, capacities
    return best[1:]


def _fill(sizes: list[int], lengths: tuple[int, ...], costs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(bin of each size, contents of each bin) with these lengths to open."""
    room_of: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    some = 0  # bit r: a bin with room r is open
    counts, left = [0] * (lengths[-1] + 1), 0
    for size in sizes:
        counts[size] += 1
        left |= 1 << size
    left &= ~1  # pieces without tokens fill nothing
    of, used = [], []
    for size in sizes:
        counts[size] -= 1
        if not counts[size]:
            left &= ~(1 << size)
        above = some >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            bin_ = room_of[room].pop()
            if not room_of[room]:
                some &= ~(1 << room)
        else:
            bin_, room = len(used), _opened(size, lengths, left, counts, costs)
            used.append(0)
        used[bin_] += size
        if rest := room - size:
            room_of[rest].append(bin_)
            some |= 1 << rest
        of.append(bin_)
    return of, used


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, n_tokens and the bin, its length and the place of every piece.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``.  Only ids and sizes are
    shuffled, and of the rows only their number goes to the driver.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    n_groups = max(1, -(-docs.count() // group))
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), word_count(docs[text_col]).alias("size"), F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("c"))
    rows = named.select(F.pmod(F.xxhash64("doc_id", "c"), F.lit(n_groups)).alias("g"), "doc_id", "size")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []  # (-tokens, place in the run, id, piece)
        current, run, place = None, 0, 0

        def close() -> pa.RecordBatch:
            held.sort()
            of, used, capacities = best_fit([-x[0] for x in held], lengths, overhead, attention)
            offsets, at = [], [0] * len(used)
            for x, b in zip(held, of, strict=True):
                offsets.append(at[b])
                at[b] -= x[0]
            data = [
                pa.array([x[2] for x in held], pa.int64()), pa.array([x[3] for x in held], pa.int32()), pa.array([-x[0] for x in held], pa.int64()),
                pa.array([f"{current}-{run}-{b}" for b in of]), pa.array([used[b] for b in of], pa.int64()), pa.array([capacities[b] for b in of], pa.int64()), pa.array(offsets, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(data, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for g, doc, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (g != current or len(held) >= 4 * group):
                    yield close()
                    run = run + 1 if g == current else 0
                    held.clear()
                elif g != current:
                    run = 0
                current = g
                for piece, start in enumerate(range(0, max(size, 1), most)):
                    held.append((-min(most, size - start), place, doc, piece))
                    place += 1
        if held:
            yield close()

    return rows.repartition("g").sortWithinPartitions("g", "doc_id", "size").mapInArrow(packed, SCHEMA)
