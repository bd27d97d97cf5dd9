"""Toxicity by Levenshtein automata intersected with a lexicon trie.

A lexicon is learned from labelled documents: stems (word beginnings) and
whole words that toxic documents hold and clean ones don't.  The lexicon's
trie and the Levenshtein automata of its whole words (one edit) are run
together as one automaton whose states are sets of (trie node, edits), made as
they are met; it finds misspelled terms in one pass over a word.  Each (term,
edits) weighs what the labelled documents say of it, and a hit's weight is
scaled by the window of words around it: less between quotation marks or after
reporting words, more beside other hits.  score = 1 - prod(1 - weight).

Labels are read only for documents with crc32(doc_id as text) mod 4 other
than 2, and of them at most ``TRAIN_DOCS`` (those with the least hash), of each
one text; with the ``TERMS`` looked at this bounds what is fitted, broadcast and held by the driver.  Scoring covers every
whole text and does not shuffle.

Defined results: null and empty texts have the score of a text without hits;
a null doc_id counts as '' for held_out; documents with contradicting labels
count as toxic; rows with null labels are not learned from; without labelled
rows the lexicon is empty; repeated rows each give a row; extra columns are
kept by ``reject`` and otherwise not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .storage import kept

TRAIN_DOCS = 12_000
TERMS = 20_000  # candidates among which the lexicon's terms are chosen, those of most toxic documents
LIMIT = 0.3
MEMO_WORDS = 300_000
WINDOW = 6
_WORD = re.compile(r"[^\W_]+(?:[*@$!'’-][^\W_]+)*")
_QUOTES = "\"“”„«»‹›"
# fixed values: words that report what others said
_REPORTING = frozenset("said says quote quoted quotes word words term called cites wrote dit mot wort sagte dijo palabra".split())


class Lexicon:
    """Entries (text, is a stem) with a weight for each number of edits."""

    def __init__(self, entries: list[tuple[str, bool]], weights: dict[tuple[int, int], float], base: float) -> None:
        self.entries, self.weights, self.base = entries, weights, base
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.fuzzy: list[bool] = [False]  # a whole word that bears an edit ends at or below the node
        for k, (text, is_stem) in enumerate(entries):
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.fuzzy.append(False)
                node = self.children[node][c]
                path.append(node)
            if is_stem:
                self.stem[node] = k
            else:
                self.word[node] = k
                if len(text) >= 5:
                    for n in path:
                        self.fuzzy[n] = True
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.index: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo = list(items)
        while todo:  # leaving out a character of the term
            node, edits = todo.pop()
            if edits == 0:
                for child in self.children[node].values():
                    if self.fuzzy[child] and (child, 1) not in items:
                        items.add((child, 1))
        key = tuple(sorted(items))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                items.add((child, edits))
            if edits == 0 and self.fuzzy[node]:
                items.add((node, 1))  # a character too many
                items.update((x, 1) for x in self.children[node].values() if self.fuzzy[x])
        got = self._state(items) if items else -1
        self.steps[state][c] = got
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the best match of a word, the heaviest stem or word."""
        state, found = self.start, []
        for c in word:
            step = self.steps[state].get(c)
            if step is None:
                step = self._step(state, c)
            if step < 0:
                state = -1
                break
            state = step
            for node, edits in self.states[state]:
                if edits == 0 and self.stem[node] >= 0:
                    found.append((self.stem[node], 0))
        if state >= 0:
            for node, edits in self.states[state]:
                k = self.word[node]
                if k >= 0 and (edits == 0 or len(self.entries[k][0]) >= 5):
                    found.append((k, edits))
        if not found:
            return None
        return max(found, key=lambda x: (self.weights.get(x, 0.0) if self.weights else -x[1], -x[0], -x[1]))

    def score(self, text: str, memo: dict[str, tuple[int, int] | None]) -> tuple[float, int]:
        low = text.lower()
        seen = set(_WORD.findall(low))
        hits = set()
        for word in seen:
            if word in memo:
                got = memo[word]
            else:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                got = self.match(word)
                if len(word) <= 64:
                    memo[word] = got
            if got is not None and self.weights.get(got, 0.0) > 0:
                hits.add(word)
        if not hits:
            return self.base, 0
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        at = [i for i, w in enumerate(words) if w[0] in hits]
        clean, places = 1 - self.base, set(at)
        for i in at:
            word = words[i][0]
            weight = self.weights[self.match(word)]
            a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            left, right = low[words[a][1] : words[i][1]], low[words[i][2] : words[b - 1][2] + 1]
            opened = sum(left.count(q) for q in _QUOTES) % 2 == 1 and any(q in right for q in _QUOTES)
            reported = any(w[0] in _REPORTING for w in words[max(0, i - 3) : i])
            company = sum(1 for j in range(a, b) if j in places and j != i)
            scale = (0.35 if opened else 1.0) * (0.6 if reported else 1.0) * (1 + 0.25 * min(company, 2))
            clean *= 1 - min(0.999, weight * scale)
        return 1 - clean, len(at)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _counted(sample: DataFrame, keys_of, schema: str = "key string, toxic long, clean long") -> DataFrame:
    """Sums over documents of what ``keys_of(text)`` names, by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tallies[toxic].update(keys_of(text))
        keys = sorted(tallies[0].keys() | tallies[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tallies[1][k] for k in keys], pa.int64()), pa.array([tallies[0][k] for k in keys], pa.int64())], names=["key", "toxic", "clean"])

    parts = sample.select("text", "toxic").mapInArrow(count, schema)
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings(text: str) -> set[str]:
    """Beginnings of 4 to 8 characters as they are, whole words ending in '$'."""
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(word[:n] for n in range(4, min(8, len(word)) + 1))
        if 4 <= len(word) <= 24:
            out.add(word + "$")
    return out


def _cover(toxic: DataFrame, told: dict[str, tuple[int, int]]) -> list[str]:
    """The terms that account for the sample's toxic documents.

    Greedy: the term with the most documents not yet accounted for, each clean
    document that holds it counting against five, longer ones first at a tie.
    Chance terms stand in documents that a real one accounts for.  Terms that
    are as frequent as the accepted ones and in no clean document join them.
    """
    names = sorted(told)
    number = toxic.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(names)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number.value[k] for k in _beginnings(t) if k in number.value] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    docs = [set(r.held) for r in toxic.select("text").mapInArrow(held, "held array<int>").collect()]  # bounded by the sample
    new: Counter = Counter(x for d in docs for x in d)
    least, accepted = max(2, len(docs) // 200), []
    rank = lambda x: (new[x] - 5 * told[names[x]][1], names[x].endswith("$"), len(names[x]), names[x])
    while new:
        best = max(new, key=rank)
        if rank(best)[0] < least:
            break
        accepted.append(best)
        for d in [d for d in docs if best in d]:
            new.subtract(d)
            docs.remove(d)
        new += Counter()
    if accepted:
        usual = sorted(told[names[x]][0] for x in accepted)[len(accepted) // 2]
        begun = tuple(names[x].rstrip("$") for x in accepted)
        for x in sorted(range(len(names)), key=lambda x: (not names[x].endswith("$"), -len(names[x]), names[x])):
            name = names[x].rstrip("$")
            if told[names[x]][1] == 0 and told[names[x]][0] >= max(3, usual / 2) and not name.startswith(begun) and not any(b.startswith(name) for b in begun):
                accepted.append(x)
                begun += (name,)
    return [names[x] for x in sorted(accepted)]


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, support: int = 3, precision: float = 0.8, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """The lexicon and weights that the sampled labelled rows give."""
    marks = labels.select(labels[label_id].alias("label_id"), labels[label_col].cast("int").alias("toxic")).where("label_id is not null and toxic is not null").where(~held_out(F.col("label_id")))
    chosen = marks.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(train_docs)
    texts = docs.select(docs[id_col].alias("label_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where(~held_out(F.col("label_id")))
    # at most train_docs ids are broadcast; of an id that rows repeat, one text is taken
    found = texts.join(F.broadcast(chosen), "label_id").groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    sample = kept(found.select("one.text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")))
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Lexicon([], {}, 0.01)
    base = n[1] / (n[1] + n.get(0, 0))
    share = docs.sparkSession.sparkContext.broadcast
    often = [r.key for r in _counted(sample.where("toxic = 1"), _beginnings).where(F.col("toxic") >= support).select("key").collect()]
    wanted = share(frozenset(often))
    told = _counted(sample, lambda text: _beginnings(text) & wanted.value).where(F.col("toxic") >= F.lit(precision) * (F.col("toxic") + F.col("clean"))).orderBy(F.desc("toxic"), "clean", "key").limit(TERMS).collect()
    entries = [(k.rstrip("$"), not k.endswith("$")) for k in _cover(sample.where("toxic = 1"), {r.key: (r.toxic, r.clean) for r in told})]
    draft = share(Lexicon(entries, {}, 0.0))

    def matches(text: str) -> set[str]:
        found = (draft.value.match(w) for w in set(_WORD.findall(text.lower())))
        return {f"{k},{e}" for k, e in filter(None, found)}

    weights: dict[tuple[int, int], float] = defaultdict(float)
    for r in _counted(sample, matches).collect():
        k, e = map(int, r.key.split(","))
        weights[k, e] = ((r.toxic + base) / (r.toxic + r.clean + 1)) ** 2
    for k, (text, stem) in enumerate(entries):  # a misspelling that is not met weighs half of its term
        if not stem and len(text) >= 5 and (k, 0) in weights:
            weights.setdefault((k, 1), 0.5 * weights[k, 0])
    return Lexicon(entries, {x: w for x, w in weights.items() if w > 0.25}, 0.01)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (the columns of ``docs`` in a struct ``row``), score, n_hits."""
    row = F.struct(*(keep or [docs[c] for c in docs.columns])).alias("row")
    lexicon_ = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample
    inner = docs.select(row, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, int] | None] = {}
        for batch in batches:
            got = [lexicon_.value.score(text.as_py(), memo) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32())], names=["row", "score", "n_hits"])

    schema = StructType([inner.schema["row"], StructField("score", DoubleType()), StructField("n_hits", IntegerType())])
    return inner.mapInArrow(scored, schema)


def reject(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``."""
    return score(docs, learn(docs, labels)).where(F.col("score") < limit).select("row.*")
