"""The main text of web pages: blocks labelled by a minimum cut between a classifier's costs and the wish that neighbours agree."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Beside, quoted, released
from .html_blocks import AWAY, MAIN, NOTHING, Block, blocks

#: Pages the classifier learns from at most, about; and blocks of each kind.
TRAIN_PAGES, TRAIN_BLOCKS = 4_000, 20_000
#: Characters of pages that are looked at together.
PIECE = 4_000_000
#: Costs in hundredths: most that the wording says, what containers say (by kind, by a name), and a block outside the page's marked main text.
WORDING, SURE, NAMED, OUTSIDE = 200, 600, 500, 300
#: Costs of telling neighbours apart: by adjacency (halved with every element between), next in one parent, next in one grandparent. Where their containers
#: say different things a quarter is left.
ADJACENT, SIBLING, COUSIN = 80, 60, 30
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTED = frozenset(("li", "dd", "dt", "td", "th", "option"))
ENDS = frozenset(".!?:;…。！？\"”»")
FEATURES = 12
#: Weights where no page marks its main text: long blocks with full sentences and few links.
PRIOR = np.array([-1.5, 3.0, -3.0, -0.5, 0.8, 2.0, -0.8, 0.3, -0.5, 1.0, 1.0, -0.5])

_MARK, _DIGIT = re.compile("[,.;!?。，]"), re.compile("[0-9]")


def describe(page: Sequence[Block]) -> np.ndarray:
    """A row for each block by its wording and that of its neighbours; containers and class names are not looked at."""
    x = np.zeros((len(page), FEATURES))
    if not len(page):
        return x
    rows = []
    for b in page:
        t, first = b.text, "".join([w[0] for w in b.text.split(" ")])
        words = len(first)
        capital = words if first.isupper() else 0 if first.islower() else sum(map(str.isupper, first))
        rows.append((1, words, b.linked / len(t), b.linked > 0, t[-1] in ENDS, min(1.0, len(_MARK.findall(t)) / words), b.tag in LISTED, b.tag in HEADINGS, len(_DIGIT.findall(t)) / len(t), len(t), 0, capital / words))
    x[:] = rows
    x[:, 1] = np.minimum(np.log1p(x[:, 1]) / 4, 2)
    near = np.concatenate([[0], x[:, 1], [0]])
    x[:, 10] = (near[:-2] + near[2:]) / 2
    x[:, 9] /= x[:, 9].max()
    return x


def weak_label(b: Block) -> int | None:
    """1 inside an element made for main text, 0 in one made for something else, else None."""
    return {MAIN: 1, AWAY: 0}.get(b.state) if b.sure else None


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method, both classes with equal weight, drawn to PRIOR; PRIOR itself with one class or none."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    penalty *= len(y)
    w, weight = PRIOR.copy(), np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * (w - PRIOR)
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
    return w


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    size = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, size[i] + PIECE, "right")) - 1)
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j


def train(pages: DataFrame, id_cols: Sequence[str] = ("page_id", "url"), html_col: str = "html", most_pages: int = TRAIN_PAGES, most_blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights of the wording, learnt from blocks whose containers tell what they are (article, main, nav, footer, ..).

    About most_pages pages are read for it, chosen by a hash of their ids, and at most most_blocks blocks of each kind, as rows of
    FEATURES numbers; the order of rows does not matter. Both bounds are parameters; the pages to extract are not bounded by them.
    """
    n = pages.count()
    steps = 1 << 30
    chosen = pages.where(F.pmod(F.xxhash64(*[F.col(quoted(c)).cast("string") for c in id_cols]), F.lit(steps)) < int(steps * min(1.0, most_pages / max(1, n))))
    names = [f"x{i}" for i in range(FEATURES)]

    def run(batches):
        for batch in released(batches):
            for _, texts in _pieces(batch.column(0)):
                found = list(map(blocks, texts))
                x = np.concatenate([describe(p) for p in found]) if found else np.zeros((0, FEATURES))
                y = [weak_label(b) for p in found for b in p]
                known = np.array([v is not None for v in y], bool)
                cols = [pa.array(np.array([v for v in y if v is not None], np.int32)), *[pa.array(c) for c in x[known].T]]
                yield pa.RecordBatch.from_arrays(cols, ["y", *names])

    rows = chosen.select(F.col(quoted(html_col)).alias("html")).mapInArrow(run, "y int, " + ", ".join(f"{c} double" for c in names))
    got = [rows.where(f"y = {y}").orderBy(F.xxhash64(*names), *names).limit(most_blocks).toPandas().to_numpy(float).reshape(-1, FEATURES + 1) for y in (0, 1)]
    both = np.concatenate(got)
    return fit(both[:, 1:], both[:, 0])


def terminals(page: Sequence[Block], wording: np.ndarray) -> list[int]:
    """What it costs, in hundredths, to call each block something else (positive) or main text (negative).

    wording: the classifier's log odds. If main text is marked on the page, a block outside the marks is held to be something else, but for a first heading.
    """
    marked = sum(len(b.text) for b in page if b.state == MAIN)
    cost = np.clip(np.round(100 * wording), -WORDING, WORDING).astype(int).tolist()
    for i, b in enumerate(page):
        if b.state == NOTHING:
            cost[i] -= OUTSIDE if marked and b.tag != "h1" else 0
        else:
            cost[i] += b.state * (SURE if b.sure else NAMED)
    return cost


def links(page: Sequence[Block]) -> dict[tuple[int, int], int]:
    """(i, j) -> cost of telling blocks i < j apart: neighbours on the page, and the next block of one parent and of one grandparent."""
    out: dict[tuple[int, int], int] = {}
    parent: dict[int, int] = {}
    grand: dict[int, int] = {}
    for j, b in enumerate(page):
        near = [(j - 1, ADJACENT >> min(6, max(0, b.step - 2) // 2))] if j else []
        near += [(parent[b.parent], SIBLING)] if b.parent in parent else []
        near += [(grand[b.grand], COUSIN)] if b.grand in grand else []
        for i, w in near:
            w = w if page[i].state == b.state else w >> 2
            if w:
                out[i, j] = out.get((i, j), 0) + w
        parent[b.parent] = grand[b.grand] = j
    return out


def minimum_cut(cost: Sequence[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """The blocks on the source's side of a minimum cut: of all labellings with the least total cost, the one with the fewest main blocks.

    cost: capacity from the source (positive) or to the sink (negative) of each block; edges: capacity in both directions. Flow is sent along shortest paths from
    blocks with a surplus to blocks with a need, level by level, until none is left; what a surplus still reaches is the source's side.
    """
    n, left = len(cost), list(cost)
    to: list[int] = []
    cap: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for (i, j), w in edges.items():
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += (j, i)
        cap += (w, w)
    while True:
        level = [0 if c > 0 else -1 for c in left]
        wave, met = [v for v in range(n) if left[v] > 0], False
        while wave and not met:
            new = []
            for v in wave:
                for a in arcs[v]:
                    u = to[a]
                    if cap[a] and level[u] < 0:
                        level[u] = level[v] + 1
                        new.append(u)
                        met = met or left[u] < 0
            wave = new
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            if left[s] <= 0:
                continue
            path: list[int] = []  # arcs from s to v
            v = s
            while left[s] > 0:
                if left[v] < 0:
                    flow = min([left[s], -left[v], *[cap[a] for a in path]])
                    left[s] -= flow
                    left[v] += flow
                    for a in path:
                        cap[a] -= flow
                        cap[a ^ 1] += flow
                    first = next((k for k, a in enumerate(path) if not cap[a]), len(path))
                    if first < len(path):
                        v = to[path[first] ^ 1]
                        del path[first:]
                    continue
                while at[v] < len(arcs[v]) and not (cap[arcs[v][at[v]]] and level[to[arcs[v][at[v]]]] == level[v] + 1):
                    at[v] += 1
                if at[v] < len(arcs[v]):
                    path.append(arcs[v][at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break


def main_text(pages: Sequence[str], weights: np.ndarray) -> list[str]:
    """The main text of each page: its blocks on the source's side, joined by line breaks."""
    out = []
    for page in map(blocks, pages):
        side = minimum_cut(terminals(page, describe(page) @ weights), links(page))
        out.append("\n".join(b.text for b, own in zip(page, side, strict=True) if own))
    return out


def extract(pages: DataFrame, keep: Sequence[Column], weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """The columns in keep, text and n_chars (its code points) of every whole page, one by one.

    A null or empty page, and one without main text, has an empty text; repeated rows have equal texts and an empty table gives an empty one. Columns in keep
    may have any names; if one has the name of a result, the result's is made longer by an underscore.
    """
    beside = Beside(pages, keep, [F.col(quoted(html_col))], {"text": "string", "n_chars": "long"})
    kept, names = beside.kept, beside.names
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in released(batches):
            rest = batch.select(range(kept))
            for i, texts in _pieces(batch.column(kept)):
                text = pa.array(main_text(texts, sent.value), pa.string())
                yield pa.RecordBatch.from_arrays([*rest.slice(i, len(texts)).columns, text, pa.compute.utf8_length(text).cast(pa.int64())], names)

    return beside.map(run)
