"""Token counts by a linear longest-match automaton.

A vocabulary trie gets a failure link and a popped-piece count for each node:
when the next byte cannot be matched, the link leads to the node for what is
left after taking the greedy longest-match pieces, and the count says how many
pieces that were.  A word of m bytes takes O(m) steps, and no piece is built.

The vocabulary is byte-level (every single byte is a piece).  Each word, a
maximal run other than ``[\\x20\\x09-\\x0D]``, is matched with one space before
it, as such vocabularies mark the start of a word.

Defined results: null and empty texts have 0 words and 0 tokens; a word that
the vocabulary cannot spell counts as one unknown token; repeated rows each
give a row; columns other than the id and the text are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO_WORDS = 400_000  # words whose counts a task keeps; the table is emptied when full
SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long"
_FOLD = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with lines ``base64 rank``; read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """``count(word)``: pieces of the greedy longest-match split of bytes."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                step = edges[node].get(byte)
                if step is None:
                    step = edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(False)
                node = step
            final[node] = node != 0
        link, popped = [-1] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for byte, node in edges[parent].items():
                    deeper.append(node)
                    if final[node]:
                        link[node], popped[node] = 0, 1
                        continue
                    back, taken = link[parent], popped[parent]
                    while back >= 0 and byte not in edges[back]:
                        taken += popped[back]
                        back = link[back]
                    if back >= 0:
                        link[node], popped[node] = edges[back][byte], taken
            level = deeper
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = taken = 0
        for byte in word:
            step = edges[node].get(byte)
            while step is None:
                taken += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                step = edges[node].get(byte)
            node = step
        while node:
            taken += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return taken



def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every whole text; no shuffle."""
    # the vocabulary file's size bounds what is broadcast
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(shared.value)
        memo: dict[bytes, int] = {}
        for batch in batches:
            sizes = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py() or b""
                words = raw.translate(_FOLD).split(b" ")
                total = n = 0
                for word in words:
                    if word:
                        n += 1
                        got = memo.get(word)
                        if got is None:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            got = automaton.count(b" " + word)
                            if len(word) <= 64:
                                memo[word] = got
                        total += got
                sizes[i] = len(raw), n, total
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sizes[:, k]) for k in range(3))], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, SCHEMA)
