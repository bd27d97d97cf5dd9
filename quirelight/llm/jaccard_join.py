"""N-gram Jaccard join: all pairs with similarity 0.75 or more, as components.

A document's set holds the 64-bit hashes of its distinct five-word shingles
(fewer words: the whole sequence as one).  Equal sets form a class, known by a
64-bit hash of the set.

1. Count: each block of documents sends the tokens of its classes, packed, to
   the token's bucket, which counts the classes of each token and answers those
   classes whose token another one has too.  Tokens that many sets of a block
   share are known from a first pass and are not sent to one bucket.
2. Gather: a class now has its shared tokens and how frequent each is in all
   documents.  Whatever two sets have in common is among the shared tokens of
   both, so sets with too few of them are done, and the others are compared by
   these alone, without their texts.  Similar sets share a token of their
   prefixes in the order of frequency, the rarest first.
3. Clusters: sets of like size that share a prefix token, joined.  What meets
   in one task is linked there, so a token goes on once a task.
4. Join: a cluster's sets meet in a signature tree; the pairs of leaves that
   its dual traversal leaves are checked exactly.  Sets known to be connected
   are not compared again.  Large clusters are cut into chunks; each chunk is
   joined, then one set a component across chunks, and at last only the sets
   outside a cluster's largest component against all.

Defined results: null and empty texts have 0 shingles and are linked with
nothing, so component_id is their own doc_id; rows that repeat a doc_id are
separate documents; a null doc_id never names a component (component_id is
null if all ids in it are null); an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Forest, components
from .signature_tree import bitmap_of, spanning_links
from .storage import dropped, kept, packed, partitions, unpacked, written
from .text_hash import U, mix, row_shingles

BLOCK_TOKENS = 2_000_000  # of sets that are dealt at once, and of a bucket
OFTEN = 64  # sets of a block that share a token that is not sent to one bucket
HOT_TOKENS = 1_000_000
CHUNK_TOKENS, CHUNK_SETS = 3_000_000, 4000
WIDTH = 5


def class_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    h = mix(mix(tokens).sum(dtype=U, keepdims=True) + U(len(tokens) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return int(h.view(np.int64)[0])


def prefix_length(n: int) -> int:
    """Tokens of which similar sets share one: n - ceil(3n/4) + 1."""
    return n - -(-3 * n // 4) + 1


def _batch(names: str, *columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [[x.to_pybytes() if isinstance(x, pa.Buffer) else x for x in c] if len(c) == 1 else c for c in columns]
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _row_values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; blobs as buffers in it, without copying."""
    columns = batch.columns
    for i in range(batch.num_rows):
        yield tuple(c[i].as_buffer() if pa.types.is_binary(c.type) and c[i].is_valid else c[i].as_py() for c in columns)


_ROWS = "kind int, a long, b long, n long, t long"


def _survey(often: int, most: int):
    """kind 0: (doc_id, class, size, text hash); kind 1: (token, sets of a block), if ``often`` at least."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def tally() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(block) if block else np.zeros(0, U), return_counts=True)
            some = counts >= often
            k = int(some.sum())
            return _batch(_ROWS, [1] * k, tokens[some].view(np.int64), [None] * k, counts[some], [None] * k)

        for batch in batches:
            keys, sizes = [], []
            for _, tokens in row_shingles(batch.column(1), WIDTH):
                keys.append(key := class_key(tokens))
                sizes.append(len(tokens))
                if key not in seen:
                    seen.add(key)
                    block.append(tokens)
                    held += len(tokens)
                if held > most:
                    yield tally()
                    block, held = [], 0
                    seen.clear()
            yield _batch(_ROWS, [0] * len(keys), batch.column(0).to_pylist(), keys, sizes, batch.column(2).to_pylist())
        yield tally()

    return survey


def _planes(x: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their differences, the lowest of all first; the high ones are 0."""
    return np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def _home(cls: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(cls.view(U)) % U(buckets)).astype(np.int64)


# bucket of tokens; of classes, if answered; classes, their sizes, and of each token: its class (its number in
# the table; answered: tokens a class), itself (answered: as it is), and answered: its place in the order
_DEALT = "bucket int, home int, cls binary, n binary, at binary, token binary, place binary"
_ANSWER = "home int, cls binary, n binary, many binary, token binary, place binary"
_LATE = 1 << 31  # the place of tokens that are not counted in a bucket, after all others


def _answers(cls: np.ndarray, n: np.ndarray, token: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of ``_ANSWER`` from one entry a class and token."""
    order = np.argsort(cls, kind="stable")
    home = _home(cls[order], buckets)
    order = order[np.argsort(home, kind="stable")]
    cls, n, token, place, home = cls[order], n[order], token[order], place[order], _home(cls[order], buckets)
    cuts = np.searchsorted(home, np.arange(buckets + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        s = slice(cuts[k], cuts[k + 1])
        start = np.flatnonzero(np.concatenate([[True], cls[s][1:] != cls[s][:-1]]))
        many = np.diff(np.append(start, cuts[k + 1] - cuts[k]))
        yield k, cls[s][start].tobytes(), n[s][start].astype("<u4").tobytes(), many.astype("<u4").tobytes(), token[s].tobytes(), place[s].astype("<u4").tobytes()


def _deal(hot, buckets: int, most: int):
    """Rows of ``_DEALT``: the tokens of the classes of a block by bucket; of frequent tokens, answers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = hot.value  # tokens in ascending order and how frequent each is
        keys: list[int] = []
        taken: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            cls, n = np.array(keys, np.int64), np.array([len(t) for t in taken], "<u4")
            token, owner = np.concatenate(taken), np.repeat(np.arange(len(keys)), n)
            if len(known):
                at = np.searchsorted(known, token)
                at[at == len(known)] = 0
                late = known[at] == token
                w = owner[late]
                for home, *row in _answers(cls[w], n[w], token[late], _LATE + rank[at[late]].astype(np.int64), buckets):
                    yield _batch(_DEALT, [home], [home], *([x] for x in row))
                token, owner = token[~late], owner[~late]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            bucket = ((token >> U(48)) * U(buckets)) >> U(16)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1).astype(U))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                s = slice(cuts[k], cuts[k + 1])
                there, at = np.unique(owner[s], return_inverse=True)
                at = at.astype("<u4").view(np.uint8).reshape(-1, 4).T
                yield _batch(_DEALT, [k], [None], [cls[there].tobytes()], [n[there].tobytes()], [at.tobytes()], [_planes(token[s])], [None])

        for batch in batches:
            for _, tokens in row_shingles(batch.column(0), WIDTH):
                if not len(tokens) or (key := class_key(tokens)) in seen:
                    continue
                seen.add(key)
                keys.append(key)
                taken.append(tokens)
                held += len(tokens)
                if held > most:
                    yield from out()
                    keys, taken, held = [], [], 0
                    seen.clear()
        yield from out()

    return deal


def _count(buckets: int):
    """Answers to the classes whose token another class has too; a bucket's rows come one after another."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def counted() -> Iterator[pa.RecordBatch]:
            cls, n, token = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            order = np.lexsort((cls, token))
            cls, n, token = cls[order], n[order], token[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])  # copies in several blocks
            cls, n, token = cls[new], n[new], token[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            many = np.diff(np.append(start, len(token)))
            many = np.repeat(many, many)
            some = many > 1
            for row in _answers(cls[some], n[some], token[some], np.minimum(many[some], _LATE - 1), buckets):
                yield _batch(_ANSWER, *([x] for x in row))

        for batch in batches:
            for bucket, home, *row in _row_values(batch):
                if home is not None:
                    yield _batch(_ANSWER, [home], *([x] for x in row))
                    continue
                if bucket != current and held:
                    yield from counted()
                current = bucket
                cls, n, at, token, _ = row
                at = np.frombuffer(at, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                held.append((np.frombuffer(cls, np.int64)[at], np.frombuffer(n, "<u4")[at], _ascending(token)))
        if held:
            yield from counted()

    return count


# a run of sets that share a token, one of which names it, with its least and largest size on a log scale
_RUN = np.dtype([("token", "<u8"), ("cls", "<i8"), ("low", "<u2"), ("high", "<u2")])
_FIT = 288  # 1000 * ln(4/3), rounded up: sizes further apart cannot be similar enough


def _runs(token: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows, sorted by (token, low), go on the run of the row before."""
    if not len(token):
        return np.zeros(0, bool)
    same = np.concatenate([[False], token[1:] == token[:-1]])
    group = np.cumsum(~same) * (1 << 20)
    reach = np.maximum.accumulate(high.astype(np.int64) + group)
    return same & np.concatenate([[False], low[1:].astype(np.int64) + group[1:] - reach[:-1] <= _FIT])


def _edges(cls: np.ndarray, goes_on: np.ndarray) -> tuple[list[int], list[int]]:
    """The links of neighbours in runs, contracted to a forest."""
    at = np.flatnonzero(goes_on)
    forest = Forest()
    for x, y in np.unique(np.stack([cls[at - 1], cls[at]], axis=1), axis=0).tolist():
        forest.join(x, y)
    nodes = [x for x in forest.up if forest.root(x) != x]
    return nodes, [forest.root(x) for x in nodes]


# kind 0: class, size, its shared tokens in ascending order; 1: bucket, runs; 2: bucket, links
_GATHERED = "kind int, key long, n long, data binary"


def _gather(buckets: int):
    """Rows of ``_GATHERED`` of the classes that have shared tokens enough; a home's rows come one after another."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def gathered() -> Iterator[pa.RecordBatch]:
            cls, n, token, place = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            order = np.lexsort((token, place, cls))
            new = np.concatenate([[True], (cls[order][1:] != cls[order][:-1]) | (token[order][1:] != token[order][:-1])])
            order = order[new]
            cls, n, token = cls[order], n[order].astype(np.int64), token[order]
            start = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
            many = np.diff(np.append(start, len(cls)))
            first = prefix_length(n[start]) - (n[start] - many)  # the prefix without the tokens of no other set
            enough = first > 0
            for s, k in zip(start[enough].tolist(), many[enough].tolist(), strict=True):
                yield _batch(_GATHERED, [0], [int(cls[s])], [int(n[s])], [np.sort(token[s : s + k]).tobytes()])
            inside = np.arange(len(cls)) - np.repeat(start, many) < np.repeat(first, many)
            token, cls, size = token[inside], cls[inside], 1000 * np.log(n[inside])
            low, high = np.floor(size).astype(np.uint16), np.ceil(size).astype(np.uint16)
            order = np.lexsort((low, token))
            token, cls, low, high = token[order], cls[order], low[order], high[order]
            goes_on = _runs(token, low, high)
            links = np.array(_edges(cls, goes_on), np.int64).T.copy()
            begin = np.flatnonzero(~goes_on)
            if not len(begin):
                return
            runs = np.zeros(len(begin), _RUN)
            runs["token"], runs["cls"], runs["low"], runs["high"] = token[begin], cls[begin], low[begin], np.maximum.reduceat(high, begin)
            bucket = (runs["token"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            runs, cuts = runs[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            parts = np.array_split(links, min(buckets, 1 + len(links) // 1000))
            blobs = [*(runs[cuts[k] : cuts[k + 1]].tobytes() for k in full), *(p.tobytes() for p in parts)]
            yield _batch(_GATHERED, [1] * len(full) + [2] * len(parts), [*full, *range(len(parts))], [None] * len(blobs), blobs)

        for batch in batches:
            for home, cls, n, many, token, place in _row_values(batch):
                if home != current and held:
                    yield from gathered()
                current = home
                many = np.frombuffer(many, "<u4")
                held.append((np.repeat(np.frombuffer(cls, np.int64), many), np.repeat(np.frombuffer(n, "<u4"), many), np.frombuffer(token, U).copy(), np.frombuffer(place, "<u4").copy()))
        if held:
            yield from gathered()

    return gather


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of each bucket of runs; its rows come one after another."""
    held, current = [], None

    def linked(x: list[int], y: list[int]) -> pa.RecordBatch:
        return _batch("a long, b long", x, y)

    def met() -> pa.RecordBatch:
        runs = np.frombuffer(b"".join(held), _RUN)
        runs = runs[np.lexsort((runs["low"], runs["token"]))]
        return linked(*_edges(runs["cls"], _runs(runs["token"], runs["low"], runs["high"])))

    for batch in batches:
        for kind, bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != current and held:
                yield met()
                held = []
            current = bucket
            if kind == 1:
                held.append(blob)
            else:
                pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
                yield linked(pairs[:, 0], pairs[:, 1])
    if held:
        yield met()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group; columns grp, cls, n, side, known, data, sorted by grp."""
    current, members = None, {}

    def links() -> pa.RecordBatch:
        found = []
        sides = [r[1] for r in members.values()]
        if len(members) > 1 and (sides[0] is None or len(set(sides)) > 1):
            rows = list(members.values())
            order = [(int(r[3][0]), int(r[3][min(1, len(r[3]) - 1)])) for r in rows]
            found = spanning_links(list(members), [bitmap_of(r[3]) for r in rows], [r[0] for r in rows], order, [r[3] for r in rows], None if sides[0] is None else sides, [r[2] for r in rows])
        return _batch("a long, b long", [x for x, _ in found], [y for _, y in found])

    for batch in batches:
        for grp, cls, n, side, known, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if grp != current:
                if members:
                    yield links()
                current, members = grp, {}
            members[cls] = n, side, known, np.frombuffer(data, U)
    if members:
        yield links()


def _links(data: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (cls, grp, side, known) brought together with their ``data`` (cls, n, data)."""
    rows = groups.join(data, "cls").select("grp", "cls", "n", "side", "known", "data")
    return kept(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_joined, "a long, b long"))


def _spanning(data: DataFrame, member: DataFrame) -> DataFrame:
    """Links that connect what is similar in each cluster; ``member`` has cluster, cls, n."""
    member = kept(_chunked(member.select("cluster", "cls", "n")))
    links = _links(data, member.select("cls", F.concat_ws(":", "cluster", "chunk").alias("grp"), F.expr(_ONE), F.col("cls").alias("known")))
    large = member.where("chunks > 1")
    return links if large.isEmpty() else _across(data, kept(large), links)


def _clusters(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, cls and the other columns of ``classes``) of linked classes."""
    found = components(links)
    member = found.select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    member = member.unionAll(found.select(F.col("component").alias("c"), F.col("component").alias("cluster")).distinct())
    return kept(kept(member).join(classes, F.col("c") == F.col("cls")).drop("c"))


def _frequent(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many sets of a block share, ascending, and how frequent each is on a
    log scale: the most frequent steps of it that have HOT_TOKENS at most together."""
    counts = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c"))
    counts = kept(counts.select("a", F.floor(F.log2("c") * 4).alias("step")))
    steps = counts.groupBy("step").agg(F.count(F.lit(1)).alias("tokens")).collect()  # 4 rows a doubling of the count
    left, least = HOT_TOKENS, None
    for r in sorted(steps, key=lambda r: -r.step):
        if (left := left - r.tokens) < 0:
            break
        least = r.step
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int16)
    both = unpacked(counts.where(F.col("step") >= least).mapInArrow(packed, "blob binary").collect())  # 16 bytes a token
    tokens = both[:, 0].copy().view(U)
    order = np.argsort(tokens)
    return tokens[order], both[order, 1].astype(np.int16)


def _classes(docs: DataFrame, id_col: str, text_col: str, often: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n, t of every row; cls, root of linked classes)."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    survey = kept(rows.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(_survey(often, block), _ROWS))
    table = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), "n", "t")
    hot = spark.sparkContext.broadcast(_frequent(survey))
    tokens = table.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 16, max(partitions(spark), -(-tokens // block)))

    # a bucket's number is that of its partition, so none gets several
    by = lambda df, key: df.repartitionById(buckets, F.col(key).cast("int"))
    dealt = rows.select("text").mapInArrow(_deal(hot, buckets, block), _DEALT)
    answers = by(dealt, "bucket").mapInArrow(_count(buckets), _ANSWER)
    gathered, path = written(by(answers, "home").mapInArrow(_gather(buckets), _GATHERED))
    sets = gathered.where("kind = 0").select(F.col("key").alias("cls"), "n", "data")
    met = by(gathered.where("kind > 0").select("kind", "key", "data"), "key").mapInArrow(_meet, "a long, b long")
    links = _spanning(sets, _clusters(met, sets.select("cls", "n")))
    found = components(links).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    dropped(spark, path)
    return table, found


_ONE = "cast(null as int) as side"


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` (cluster, cls, n, ...) with the cluster's number of chunks and the set's."""
    per = members.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets"))
    need = F.ceil(F.greatest(F.col("tokens") / CHUNK_TOKENS, F.col("sets") / CHUNK_SETS)).cast("int")
    per = kept(per.select(F.col("cluster").alias("of"), need.alias("chunks")))
    joined = members.join(per, F.col("cluster") == F.col("of")).drop("of")
    return joined.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    found = kept(components(links))
    return kept(member.join(found.withColumnRenamed("node", "at"), F.col("cls") == F.col("at"), "left").select(*member.columns, F.coalesce("component", "cls").alias("known")))


def _across(data: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """The links of clusters of several chunks: also those across chunks."""
    before = large.agg(F.count(F.lit(1))).first()[0]
    while True:
        # one set of each component stands for it, in ever fewer chunks
        now = _labelled(large, links)
        heads = kept(now.groupBy("cluster", "known").agg(F.min(F.struct("cls", "n")).alias("head")).select("cluster", "known", "head.*"))
        several = heads.groupBy(F.col("cluster").alias("oc")).agg(F.count(F.lit(1)).alias("left")).where("left > 1")
        open_ = kept(heads.join(several, F.col("cluster") == F.col("oc"), "left_semi"))
        left = open_.count()
        if not left:
            return links
        if left > before / 2:
            break
        before = left
        groups = _chunked(open_).select("cls", F.concat_ws(":", "cluster", "chunk").alias("grp"), F.expr(_ONE), "known")
        links = kept(links.unionAll(_links(data, groups)))
    # A component that holds over half of a cluster's sets is not compared with itself: the
    # sets apart from it meet it and each other, dealt into chunks of their own.
    sizes = kept(now.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("tokens")))
    per = sizes.groupBy(F.col("cluster").alias("of")).agg(F.max(F.struct("c", "known", "tokens")).alias("top"), F.sum("c").alias("sets"), F.sum("tokens").alias("tokens"))
    main = F.col("top.c") * 2 > F.col("sets")
    rest = [F.col(x) - F.when(main, F.col(f"top.{y}")).otherwise(0) for x, y in (("tokens", "tokens"), ("sets", "c"))]
    parts = F.greatest(F.lit(1), *(F.ceil(x / most) for x, most in zip(rest, (CHUNK_TOKENS, CHUNK_SETS), strict=True))).cast("int")
    per = kept(per.select("of", F.when(main, F.col("top.known")).alias("main"), parts.alias("parts")))
    judged = kept(now.join(per, F.col("cluster") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")))
    apart = ~F.col("known").eqNullSafe(F.col("main"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    there = judged.where("main is not null").withColumn("x", F.explode(F.when(apart, every("chunks")).otherwise(F.array("chunk"))))
    there = there.withColumn("y", F.explode(F.when(apart, F.array("part")).otherwise(every("parts"))))
    against = there.select("cls", F.concat_ws(":", "cluster", "x", "y", F.lit("t")).alias("grp"), F.when(apart, 1).otherwise(0).alias("side"), "known")
    # chunks of the same number hold the same sets as before, which have met
    again = (F.col("part") != F.col("other")) | (F.col("parts") != F.col("chunks"))
    side = F.when(F.col("part") < F.col("other"), 0).when(F.col("part") > F.col("other"), 1)
    among = judged.where(apart).withColumn("other", F.explode(every("parts"))).where(again)
    among = among.select("cls", F.concat_ws(":", "cluster", F.least("part", "other"), F.greatest("part", "other")).alias("grp"), side.alias("side"), "known")
    return kept(links.unionAll(_links(data, against.unionAll(among))))


def _first(table: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, root of every class; r and its best row: least doc_id, then text hash)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = table.where("n > 0").groupBy("cls").agg(F.min(place).alias("first"))
    found = found.select(F.col("cls").alias("c"), "root")
    classes = kept(classes.join(found, F.col("cls") == F.col("c"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root")))
    return classes, kept(classes.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("best")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    table, found = _classes(docs, id_col, text_col, often, block)
    classes, first = _first(table, found)
    named = kept(classes.join(first, F.col("root") == F.col("r")).select(F.col("cls").alias("k"), F.col("best.doc_id").alias("component_id")))
    done = table.join(named, (F.col("cls") == F.col("k")) & (F.col("n") > 0), "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN, block: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` without words, and the first row of each component."""
    table, found = _classes(docs, id_col, text_col, often, block)
    _, first = _first(table, found)
    first = kept(first.select(F.col("best.doc_id").alias("__id"), F.col("best.t").alias("__t")))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    full = docs.where(worded).select(docs[id_col].cast("long").alias("__doc"), F.xxhash64(text).alias("__text"), row)
    same = full.join(first, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__t")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("__doc", "__text").orderBy(F.lit(0)))
    return same.withColumn("__nth", nth).where("__nth = 1").select("row.*").unionAll(docs.where(~worded))
