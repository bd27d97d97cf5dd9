"""Main text of pages: a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks (``dom_blocks``), each either main text or
not.  A block's features are its ancestors' tags, the words of their classes
and ids (once more for the nearest that has any), roles, the nearest section, whether it stands outside an ``article`` or ``main`` that the
page has, and shapes of its own text (length, share inside links, punctuation,
a few words).  Weights of features for each label, and of labels that follow
one another, are fitted by maximum likelihood with a quadratic penalty on
labelled pages, and the best labels of a page are found by Viterbi.

Labelled pages are any pairs of html and the list of its main blocks' texts;
``layouts.labelled_pages`` makes a stated number of them in many layouts, and
``fit`` trains on these unless given others.  The number of pages and of
features, so the model that is broadcast, is a parameter and does not grow
with what is extracted.  Each page is extracted where it is read.

Defined results: null and empty html, and pages without main text, give an
empty text; nothing is cut, however long the page; rows that repeat a page
each give a row; null ids and urls stay null; columns other than the three
named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom_blocks import PAGE_WIDE, Block, blocks
from .layouts import labelled_pages

PAGES, SEED = 900, 13  # labelled pages to train on
PENALTY, ROUNDS, RATE = 0.02, 250, 0.15
LEAST = 4  # blocks that must show a feature for it to have a weight
_OUT_BYTES = 1 << 22
SCHEMA = "page_id long, url string, text string, n_chars long"
# fixed values: words that notices, menus, adverts and comment lists use
CUES = frozenset(
    """© advertisement advertisements anzeige comment comments cookie cookies copyright datenschutz facebook follow home impressum login logout
    menu newsletter next previous privacy promoted publicité publicidad publicidade register related reply reserved rights search share sign sponsored
    subscribe terms twitter username password""".split()
)
_LENGTHS = ((3, "1"), (6, "3"), (12, "6"), (25, "12"), (60, "25"))


def text_features(block: Block) -> list[str]:
    words = block.text.split()
    n = len(words)
    size = next((name for most, name in _LENGTHS if n < most), "60")
    share = block.linked / max(1, len(block.text))
    link = "l=none" if share < 0.05 else "l=some" if share < 0.4 else "l=most" if share < 0.8 else "l=all"
    end = "e=stop" if block.text[-1] in ".!?…。»”\"" else "e=open"
    out = [f"n={size}", link, end, f"i={block.tag}", f"i={block.tag} {link}", f"n={size} {end}", f"n={size} {link}"]
    if n <= 40:
        out += {f"w={w}" for x in words if (w := x.strip(".,:;!?()[]|·").lower()) in CUES}
    return out


def _outside(found: list[Block]) -> tuple[str, ...]:
    return tuple(t for t in PAGE_WIDE if any(t in b.around for b in found))


def features(found: list[Block]) -> list[list[str]]:
    """The features of each block of one page."""
    has = _outside(found)
    return [["bias", *b.around, *(f"out {t}" for t in has if t not in b.around), *text_features(b)] for b in found]


def aligned(found: list[Block], main: Iterable[str]) -> list[int]:
    """Label 1 for blocks whose texts are the main blocks' in turn."""
    wanted, out = list(main), []
    for b in found:
        out.append(int(bool(wanted) and b.text == wanted[0]))
        if out[-1]:
            wanted.pop(0)
    if wanted:
        raise ValueError(f"main text is not a leaf block of the page: {wanted[0][:80]!r}")
    return out


@dataclass
class Model:
    weights: dict[str, float]  # of label 1 against label 0
    moves: np.ndarray  # [from, to], from 2: the page begins

    def decode(self, found: list[Block]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        if not found:
            return []
        weights, has, around_sum = self.weights, _outside(found), {}
        (a, b), (c, d), (s, t) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        off = on = 0.0
        for k, block in enumerate(found):
            base = around_sum.get(block.around)
            if base is None:
                base = around_sum[block.around] = sum(weights.get(f, 0.0) for f in ("bias", *block.around, *(f"out {x}" for x in has if x not in block.around)))
            own = base + sum(weights.get(f, 0.0) for f in text_features(block))
            if k == 0:
                off, on = s, t + own
                continue
            to_off, to_on = (0 if off + a >= on + c else 1), (0 if off + b > on + d else 1)
            back.append((to_off, to_on))
            off, on = (off + a if to_off == 0 else on + c), (off + b if to_on == 0 else on + d) + own
        label = int(on > off)
        out = [bool(label)]
        for step in reversed(back):
            label = step[label]
            out.append(bool(label))
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "", self.weights)
        return " ".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def fit(labelled: Iterable[tuple[str, list[str]]] | None = None, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood over all given pages at once (Adam on the exact gradient)."""
    pages = [(features(found), aligned(found, main)) for page, main in (labelled_pages(PAGES, SEED) if labelled is None else labelled) if (found := blocks(page))]
    if not pages:
        raise ValueError("no labelled page has a text block")
    counts: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in set(row):
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= LEAST)
    index = {f: i for i, f in enumerate(names)}
    depth = max(len(rows) for rows, _ in pages)
    cell, column = [], []  # of page p and place k is the cell k * len(pages) + p
    y = np.full((depth, len(pages)), -1)
    for p, (rows, labels) in enumerate(pages):
        for k, row in enumerate(rows):
            y[k, p] = labels[k]
            own = [index[f] for f in set(row) if f in index]
            cell += [k * len(pages) + p] * len(own)
            column += own
    cell, column = np.array(cell), np.array(column)
    size, n_cells = len(names), depth * len(pages)
    theta = np.zeros(size + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        score = np.bincount(cell, theta[:size][column], n_cells).reshape(depth, -1)
        on, moved = _gradient(score, theta[size:].reshape(3, 2), y)
        gradient = np.concatenate([np.bincount(column, on.ravel()[cell], size), moved.ravel()]) + penalty * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta -= RATE * (1 - t / (rounds + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return Model(dict(zip(names, theta[:size].tolist(), strict=True)), theta[size:].reshape(3, 2))


def _gradient(score: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected less observed: of label 1 at each place, and of each move (forward and backward sums)."""
    depth, n = score.shape
    there = y >= 0
    emit = np.stack([np.zeros_like(score), score], axis=2)
    forward, backward = np.zeros((depth, n, 2)), np.zeros((depth, n, 2))
    forward[0] = moves[2] + emit[0]
    for k in range(1, depth):
        step = np.logaddexp(forward[k - 1, :, :1] + moves[0], forward[k - 1, :, 1:] + moves[1]) + emit[k]
        forward[k] = np.where(there[k, :, None], step, forward[k - 1])
    for k in range(depth - 2, -1, -1):
        ahead = backward[k + 1] + emit[k + 1]
        step = np.stack([np.logaddexp(moves[i, 0] + ahead[:, 0], moves[i, 1] + ahead[:, 1]) for i in (0, 1)], axis=1)
        backward[k] = np.where(there[k + 1, :, None], step, 0.0)
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    on = np.where(there, np.exp(forward[:, :, 1] + backward[:, :, 1] - total) - (y == 1), 0.0)
    moved = np.zeros((3, 2))
    for j in (0, 1):
        moved[2, j] = (np.exp(forward[0, :, j] + backward[0, :, j] - total) - (y[0] == j)).sum()
        for i in (0, 1):
            pair = np.exp(forward[:-1, :, i] + moves[i, j] + emit[1:, :, j] + backward[1:, :, j] - total)
            moved[i, j] = np.where(there[1:], pair - ((y[:-1] == i) & (y[1:] == j)), 0.0).sum()
    return on, moved


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every whole page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # as large as the training pages' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            first, texts, held = 0, [], 0
            for i, page in enumerate(batch.column(2)):
                texts.append(model.main_text(page.as_py()))
                held += len(texts[-1])
                if held > _OUT_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    first, texts, held = i + 1, [], 0

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)
