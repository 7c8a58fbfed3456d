"""Breadth-first search from many starts over the edges of a group of starts, in a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Nodes in one row of the result, and rows of nodes in a batch.
NODES_A_ROW = 4096
NODES_A_BATCH = 200_000


def _ranks(values: pa.Array) -> np.ndarray:
    """Dense ranks of texts or numbers in order, nulls first."""
    coded = values.dictionary_encode()
    held = coded.dictionary.to_pylist()
    place = np.zeros(len(held) + 1, np.int64)
    place[sorted(range(len(held)), key=held.__getitem__)] = np.arange(1, len(held) + 1)
    return place[coded.indices.fill_null(len(held)).to_numpy(zero_copy_only=False)]


def _spans(at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all edges of ``nodes`` in turn, and the index of each edge's node."""
    sizes = at[nodes + 1] - at[nodes]
    whose = np.repeat(np.arange(len(nodes)), sizes)
    return np.arange(len(whose)) + (at[nodes] - np.cumsum(sizes) + sizes)[whose], whose


class Ball:
    """The edges of a group: (src, out) rows, ``out`` a list of texts, or of (f, e, file, line, dst) if places are wanted.

    With ``labels``, ``src`` and ``out`` are numbers, ``labels`` has the name of each ``src``, and targets that are no ``src`` do not count.
    """

    def __init__(self, src: pa.Array, out: pa.ListArray, places: bool, labels: pa.Array | None = None):
        sizes = out.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = out.flatten()
        dst = flat.field("dst") if places else flat
        if labels is None:
            coded = pa.concat_arrays([src, dst]).dictionary_encode()
            self.names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own, self.dst = codes[: len(src)], codes[len(src) :]
        else:
            self.names, own = labels, np.arange(len(src))
            numbers, aims = src.to_numpy(zero_copy_only=False), dst.to_numpy(zero_copy_only=False)
            order = np.argsort(numbers, kind="stable")
            place = np.minimum(np.searchsorted(numbers[order], aims), len(src) - 1)
            known = numbers[order][place] == aims
            sizes = np.bincount(np.repeat(own, sizes)[known], minlength=len(src))
            self.dst = order[place[known]]
        self.n = len(self.names)
        self.own = own
        order = np.argsort(own, kind="stable")
        at = np.zeros(self.n + 1, np.int64)
        at[own + 1] = sizes
        starts = np.r_[0, np.cumsum(sizes)][:-1][order]
        self.at = np.cumsum(at)
        moved = np.arange(len(self.dst)) + np.repeat(starts - np.r_[0, np.cumsum(sizes[order])][:-1], sizes[order])
        self.dst = self.dst[moved]
        self.seen = np.zeros(self.n, bool)
        if places:
            self.file, self.line = flat.field("file").take(pa.array(moved)), flat.field("line").take(pa.array(moved))
            self.keys = [_ranks(flat.field(c))[moved] for c in ("f", "e", "file", "line")]

    def levels(self, start: int, depth: int) -> Iterator[np.ndarray]:
        """The nodes at each depth from 1."""
        seen, reached = self.seen, [np.array([start])]
        seen[start] = True
        for _ in range(depth):
            new = self.dst[_spans(self.at, reached[-1])[0]]
            new = new[~seen[new]]
            if not len(new):
                break
            seen[new] = True
            if len(new) * 16 > self.n:
                mark = np.zeros(self.n, bool)
                mark[new] = True
                new = np.flatnonzero(mark)
            else:
                new = np.unique(new)
            reached.append(new)
            yield new
        for nodes in reached:
            seen[nodes] = False

    def placed(self, start: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nodes at each depth from 1, and the edge that found each: by the rank of its source, then by its own order."""
        seen, reached = self.seen, [np.array([start])]
        seen[start] = True
        rank = np.zeros(1, np.int64)
        for _ in range(depth):
            edges, whose = _spans(self.at, reached[-1])
            fresh = ~seen[self.dst[edges]]
            edges, whose = edges[fresh], whose[fresh]
            if not len(edges):
                break
            keys = [rank[whose], *(k[edges] for k in self.keys)]
            order = np.lexsort(keys[::-1])
            first = np.sort(np.unique(self.dst[edges[order]], return_index=True)[1])
            won = order[first]
            nodes = self.dst[edges[won]]
            # Equal ranks for what was found by edges of equal order from sources of equal rank.
            r, f, e = (k[won] for k in keys[:3])
            rank = np.r_[0, np.cumsum((r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (e[1:] != e[:-1]))]
            seen[nodes] = True
            reached.append(nodes)
            yield nodes, edges[won]
        for nodes in reached:
            seen[nodes] = False


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``g``, group by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and held[0].column("g")[0].as_py() != g[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def search(batches: Iterator[pa.RecordBatch], depth: int, places: bool) -> Iterator[pa.RecordBatch]:
    """(start, depth, nodes), with ``places`` also (files, lines), from rows (g, src, starts, out) sorted by ``g``; ``starts`` marks a start of the group.

    Rows with ``label`` have numbers for ``src`` and ``out``; the result shows labels.
    """
    for table in _groups(batches):
        table = table.combine_chunks()
        src, out = (table.column(c).chunk(0) for c in ("src", "out"))
        ball = Ball(src, out, places, table.column("label").chunk(0) if "label" in table.column_names else None)
        rows: list[tuple[str, int]] = []
        found: list[np.ndarray] = []
        edges: list[np.ndarray] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            columns = [pa.array([s for s, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.int64())]
            columns.append(pa.ListArray.from_arrays(ends, ball.names.take(pa.array(np.concatenate(found)))))
            if places:
                at = pa.array(np.concatenate(edges))
                columns += [pa.ListArray.from_arrays(ends, x.take(at)) for x in (ball.file, ball.line)]
            return pa.RecordBatch.from_arrays(columns, ["start", "depth", "nodes", "files", "lines"][: len(columns)])

        for code in ball.own[table.column("starts").chunk(0).to_numpy(zero_copy_only=False)].tolist():
            start = ball.names[code].as_py()
            for level, x in enumerate(ball.placed(code, depth) if places else ((n, n) for n in ball.levels(code, depth)), 1):
                for at in range(0, len(x[0]), NODES_A_ROW):
                    rows.append((start, level))
                    found.append(x[0][at : at + NODES_A_ROW])
                    edges.append(x[1][at : at + NODES_A_ROW])
                    size += len(found[-1])
            if size >= NODES_A_BATCH:
                yield batch()
                rows, found, edges, size = [], [], [], 0
        if rows:
            yield batch()
