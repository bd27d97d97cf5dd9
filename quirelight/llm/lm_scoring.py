"""Language-model scores: a unigram base and a causal self-attention model.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end a text.
Subword ids are the greedy longest-match pieces, among the ``RANKS`` first of a
public byte-level vocabulary, of each word with a space before it.  A text's
score is the sum of the attention model's log probabilities of all its ids, the
end among them; a piece that no training text has gets an even part of the share
of one more id, so the model is a distribution over all texts.

Training reads documents whose crc32(doc_id as text) mod 10 is not 0.  Word
counts, for the base, and counts of pairs of ids, with which the model's logits
begin, cover all of them.  Its other weights are trained on all of them too, each
read once, where the rows lie: a hash of the id deals them into ``ROUNDS`` parts,
and for each part in turn each task runs Adam over its texts from the same start
and the results are averaged by their numbers of ids.  The loss is taken at
every id; ``fit`` with ``every`` above 1 takes it at one block of
``attention_model.STRIDE`` ids in so many.

Frequent words' counts are broadcast (``TOP_WORDS`` at most); the counts of the
others meet each occurrence in a join on the word's 64-bit hash, for the base.

Defined results: null and empty texts are one end token; a null doc_id counts
as ''; without training rows every count is 0 and the model uniform; repeated
rows each give a row; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention_model as model
from .storage import kept, packed, unpacked
from .text_hash import U, chunks, lowered, mix, texts_of, word_hashes, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RANKS = 4096  # pieces, the first of the vocabulary
EVERY = 1  # the loss is taken at one block in so many
ROUNDS = 3
TOP_WORDS = 400_000
HELD = 1_000_000  # counts that a task holds before it hands them on


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


class Pieces:
    """Greedy longest-match pieces of many words at once, by a trie's table."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        final = [-1]
        for rank, piece in enumerate(vocabulary):
            node = 0
            for byte in piece:
                if byte not in edges[node]:
                    edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(-1)
                node = edges[node][byte]
            final[node] = rank
        if any(final[edges[0].get(byte, 0)] < 0 for byte in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.step = np.zeros((len(edges), 257), np.int32)  # no byte is 256
        for node, below in enumerate(edges):
            for byte, to in below.items():
                self.step[node, byte] = to
        self.final = np.array(final, np.int32)

    def split(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of all words' pieces, pieces of each word); ``ends`` are the words' last bytes."""
        size = ends - starts + 3
        begin = np.cumsum(size) - size
        buffer = np.empty(int(size.sum()), np.int16)
        inside = np.arange(len(buffer)) - np.repeat(begin, size)
        buffer[:] = raw.take(np.repeat(starts, size) + inside - 1, mode="clip")
        buffer[begin], buffer[begin + size - 1] = 0x20, 256
        # the longest piece at each place
        node = self.step[0].take(buffer)
        rank, length = self.final.take(node), np.ones(len(buffer), np.int32)
        at, deep = np.flatnonzero(buffer != 256), 1
        node = node[at]
        while len(at):
            node = self.step.ravel().take(node.astype(np.int64) * 257 + buffer.take(at + deep))
            some = node > 0
            at, node, deep = at[some], node[some], deep + 1
            whole = self.final.take(node)
            is_ = whole >= 0
            rank[at[is_]], length[at[is_]] = whole[is_], deep
        word, place, words, ranks = np.arange(len(begin)), begin.copy(), [], []
        while len(word) > 32:
            words.append(word)
            ranks.append(rank.take(place))
            place = place + length.take(place)
            left = buffer.take(place) != 256
            word, place = word[left], place[left]
        for w, a in zip(word.tolist(), place.tolist(), strict=True):  # the last few, long ones
            mine = []
            while buffer[a] != 256:
                mine.append(rank[a])
                a += int(length[a])
            words.append(np.full(len(mine), w))
            ranks.append(np.array(mine, np.int32))
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = np.concatenate(words)
        return np.concatenate(ranks)[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(begin))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a place of each, and which one every value is; quicker than a stable sort."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class Texts:
    """Texts of a chunk as words and as one stream of ranks; END follows each text and START goes before."""

    def __init__(self, pieces: Pieces, part: np.ndarray, offsets: np.ndarray) -> None:
        self.end = len(pieces.final[pieces.final >= 0])
        self.start = self.end + 1
        self.hashes, self.counts = word_hashes(part, offsets)
        self.distinct, first, self.inverse = _distinct(self.hashes)
        starts, ends = word_spans(part, offsets)
        flat, many = pieces.split(lowered(part), starts[first], ends[first])
        begin = np.cumsum(many) - many
        n = many[self.inverse]
        row = np.repeat(np.arange(len(self.counts)), self.counts)
        lengths = np.bincount(row, weights=n, minlength=len(self.counts)).astype(np.int64) + 1
        self.ranks = np.full(int(lengths.sum()), self.end, np.int32)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.ranks[np.repeat(np.cumsum(n) - n + row, n) + inside] = flat.take(np.repeat(begin[self.inverse], n) + inside)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.before = np.concatenate([[self.start], self.ranks[:-1]]).astype(np.int32)
        self.before[np.cumsum(lengths)[:-1]] = self.start


def _counted(pieces):
    """(kind, key, count): words by hash, 0, and pairs of ranks, 1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]

        def out(kind: int) -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([c for _, c in held[kind]])).astype(np.int64)
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(total)], names=["kind", "h", "c"])

        split = Pieces(pieces.value)
        narrow = np.uint32 if len(pieces.value) < 1 << 15 else U  # pairs of ranks
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for a, b in chunks(offsets):
                texts = Texts(split, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held[0].append((texts.distinct, np.bincount(texts.inverse, minlength=len(texts.distinct))))
                pairs, counts = np.unique(texts.before.astype(narrow) * narrow(texts.start + 1) + texts.ranks.astype(narrow), return_counts=True)
                held[1].append((pairs.astype(U), counts))
            for kind in (0, 1):
                if sum(len(k) for k, _ in held[kind]) > HELD:
                    yield out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield out(kind)

    return counted


def _ids(index: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids before, ids, text) of a stream, as the model numbers them."""
    return index.take(texts.before), index.take(texts.ranks), texts.text


def _trained(shared, weights, every: int, nth: int):
    """(slot, ids, weights * ids) of this task's texts."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, fixed, n, _ = shared.value
        pieces, state, size = Pieces(vocabulary), model.Adam(weights.value, n, model.RATE / (1 + nth)), 0
        for batch in batches:
            raw, offsets = texts_of(batch.column(0))
            for k, (a, b) in enumerate(chunks(offsets)):
                before, ids, text = _ids(index, Texts(pieces, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                model.train(state, fixed, before, ids, text, every, k + nth)
                size += len(ids)
        if size:
            total = state.whole.astype(np.float64) * size
            yield pa.RecordBatch.from_arrays([pa.array([int(mix(total.view(U)[:1])[0] % U(16))], pa.int32()), pa.array([size], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "tokens", "total"])

    return trained


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for batch in batches:
        for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.frombuffer(blob, np.float64)
            total = x if total is None else total + x
            tokens += n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "tokens", "total"])


_PART = "slot int, tokens long, total binary"
_SCORED = "doc_id long, held_out boolean, key long, emits boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def _scored(shared, weights, top):
    """Scores of whole texts; in the base, words beyond the frequent ones are left to a join."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, fixed, n, other = shared.value
        pieces, p = Pieces(vocabulary), model.unflat(weights.value, n)
        known, logs, end_log, end_known = top.value
        seen: set[int] = set()
        for batch in batches:
            raw, offsets = texts_of(batch.column(2))
            for a, b in chunks(offsets):
                texts = Texts(pieces, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                before, ids, text = _ids(index, texts)
                places = model.log_probabilities(p, fixed, before, ids, text)
                places[ids == n - 1] += other
                score = np.bincount(text, weights=places, minlength=b - a) / np.log(10)
                row = np.repeat(np.arange(b - a), texts.counts)
                frequent, value = np.zeros(len(texts.distinct), bool), np.zeros(len(texts.distinct))
                if len(known):
                    place = np.searchsorted(known, texts.distinct)
                    place[place == len(known)] = 0
                    frequent = known[place] == texts.distinct
                    value = np.where(frequent, logs[place], 0.0)
                often = frequent[texts.inverse]
                base = np.bincount(row, weights=value[texts.inverse], minlength=b - a) + end_log
                n_known = np.bincount(row, weights=often, minlength=b - a).astype(np.int64) + end_known
                to = np.concatenate([[0], np.cumsum(texts.counts)])
                spot = np.arange(1, len(row) + 1) - np.repeat(to[:-1], texts.counts)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(texts.hashes + spot.astype(U) * U(0x9E3779B97F4A7C15)), dtype=U)])
                keys = mix(sums[to[1:]] - sums[to[:-1]] + texts.counts.astype(U)).view(np.int64)
                # a text's rare words go on once a task
                emits = np.bincount(row, weights=~often, minlength=b - a) > 0
                for i in np.flatnonzero(emits).tolist():
                    if (key := int(keys[i])) in seen:
                        emits[i] = False
                    elif len(seen) < HELD:
                        seen.add(key)
                left = np.flatnonzero(~often & emits[row])
                ends = np.searchsorted(row[left], np.arange(b - a + 1))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts.hashes[left].view(np.int64)))
                ids_, held = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                columns = [ids_, held, pa.array(keys), pa.array(emits), pa.array(texts.counts + 1), pa.array(n_known), pa.array(base), pa.array(score), rare]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    return scored


def numbered(ranks: int, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple, int, float]:
    """(id of each rank, END and START; the model's counts; ids; log share of a rank in the last id).

    Ids go by the count, the largest first.  What was not counted shares the last.
    """
    single = np.bincount(after, weights=counts, minlength=ranks + 1)
    order = np.lexsort((np.arange(ranks + 1), -single))
    used = int((single > 0).sum())
    index = np.empty(ranks + 2, np.int32)
    index[order] = np.minimum(np.arange(ranks + 1), used)
    n = used + 1
    index[ranks + 1] = n
    return index, model.bigrams(n, index[before], index[after], counts), n, -float(np.log(max(1, ranks + 1 - used)))


def fit(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", ranks: int = RANKS, every: int = EVERY, rounds: int = ROUNDS) -> dict:
    """Word counts (a stored table), their sums, and the trained model."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    training = docs.where(remainder(docs[id_col], 10) != 0)
    text = F.coalesce(training[text_col].cast("string"), F.lit("")).alias("text")
    vocabulary = vocabulary[:ranks]
    ranks = len(vocabulary)
    counted = kept(training.select(text).mapInArrow(_counted(share(vocabulary)), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")))
    words = counted.where("kind = 0").select("h", "c")
    n, v = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    pairs = unpacked(counted.where("kind = 1").select("h", "c").mapInArrow(packed, "blob binary").collect())  # at most the square of ``ranks``
    before, after, counts = pairs[:, 0] // (ranks + 2), pairs[:, 0] % (ranks + 2), pairs[:, 1]
    texts = int(counts[after == ranks].sum())
    index, fixed, ids, other = numbered(ranks, before, after, counts.astype(float))
    weights, trained = model.flat(model.initial(ids)), 0
    shared = share((vocabulary, index, fixed, ids, other))
    part = F.pmod(F.xxhash64(training[id_col], F.lit(3)), F.lit(rounds))
    for nth in range(rounds):
        parts = training.where(part == nth).select(text).mapInArrow(_trained(shared, share(weights), every, nth), _PART)
        found = parts.repartition(16, "slot").mapInArrow(_summed, _PART).collect()  # 16 rows at most
        trained += sum(r.tokens for r in found)
        if found:
            weights = (sum(np.frombuffer(r.total, np.float64) for r in found) / sum(r.tokens for r in found)).astype(np.float32)
    return {"words": words, "tokens": (n or 0) + texts, "distinct": v + (texts > 0), "ends": texts, "trained": trained, "shared": shared, "weights": share(weights)}


def score(docs: DataFrame, fitted: dict, id_col: str = "doc_id", text_col: str = "text", top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    words, total = fitted["words"], fitted["tokens"]
    whole = total + 0.1 * (fitted["distinct"] + 1)
    step = F.floor(F.log2("c") * 4)
    least, left = None, top_words
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.step):  # 4 rows a doubling of the count
        if (left := left - r.words) < 0:
            break
        least = r.step
    top = unpacked(words.where(step >= F.lit(least)).select("h", "c").mapInArrow(packed, "blob binary").collect() if least is not None else [])
    hashes = top[:, 0].copy().view(U)
    order = np.argsort(hashes)
    logs = np.log10((top[order, 1] + 0.1) / whole)
    frequent = docs.sparkSession.sparkContext.broadcast((hashes[order], logs, float(np.log10((fitted["ends"] + 0.1) / whole)), int(fitted["ends"] > 0)))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (remainder(docs[id_col], 10) == 0).alias("held_out"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    done = kept(rows.mapInArrow(_scored(fitted["shared"], fitted["weights"], frequent), _SCORED))
    rare = done.where("emits").select("key", F.explode("rare").alias("w"))
    met = rare.join(words, F.col("w") == F.col("h"), "left")
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(whole))
    sums = met.groupBy("key").agg(F.sum(value).alias("more"), F.count("c").alias("knows"))
    # a text that several tasks met came as often: its sums are of as many copies
    often = done.where("emits").groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    sums = kept(sums.join(often, F.col("key") == F.col("k")).select("k", (F.col("more") / F.col("copies")).alias("more"), (F.col("knows") / F.col("copies")).cast("long").alias("knows")))
    full = done.join(sums, F.col("key") == F.col("k"), "left")
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("knows", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
