"""Jaccard self-join on word n-grams by T-occurrence search.

Texts that can link share many of the shingles whose hashes lie below a fixed cut, and the threshold
says how many. Pairs with fewer are ruled out by counting over short lists; long lists hook those of their
texts together that have enough shingles in long lists. The components that this leaves are cells that
no link leaves. In each cell every document that may still join two components is a query: its short inverted lists are
merged, its long ones are probed by binary search, and documents with the required overlap are linked. Large cells
are dealt to slices, and only the documents outside a cell's largest component are searched for in all of them.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_split, materialize, may_be_in, ship, sparing, steps, text_or_empty
from codeloom.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sets of n-gram hashes; words are runs of other than ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words = words

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct 64-bit hashes of each text's shingles, as uint64."""
        whole = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())
        parts = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        flat_words = parts.flatten()
        real = pc.binary_length(flat_words).to_numpy(zero_copy_only=False) > 0  # none at either end of a text
        ends = np.r_[0, np.cumsum(real)][parts.offsets.to_numpy()]
        coded = flat_words.filter(pa.array(real)).dictionary_encode()
        known = coded.dictionary.view(pa.large_binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        size = np.diff(ends)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = hashes[codes] if len(codes) else np.empty(0, np.uint64)
        n = self.words
        rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for i in range(n if len(rolled) else 0):
            rolled = rolled * _STEP + flat[i : len(flat) - n + 1 + i]
        rolled ^= rolled >> np.uint64(31)
        rolled *= _MIX
        rolled ^= rolled >> np.uint64(29)
        found, at = [], 0
        for length in size.tolist():
            if length >= n:
                held = np.sort(rolled[at : at + length - n + 1])
                found.append(held[np.r_[True, held[1:] != held[:-1]]])
            else:
                words = [known[i] for i in codes[at : at + length].tolist()]
                found.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=length)] if length else [], np.uint64))
            at += length
        return found


def required(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any set that it can link with."""
    return -(-size * percent // 100)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.uint64)).view(pa.int64()))


#: What a row of ``hook_lists`` is.
PAIR, HOOK, HEAD = 0, 1, 2


def hook_lists(batches: Iterator[pa.RecordBatch], short_list: int) -> Iterator[pa.RecordBatch]:
    """(u, v, kind, n) from rows (a, s, part) sorted by s, part and a.

    PAIR: texts u and v are in n lists together, of part 0 and of up to ``short_list`` texts. HOOK: text u is in n other lists of the
    hub v; lists of the same least text and length have one hub. HEAD: u is a shingle of part 1 or more and v its hub in that part.
    """
    held: list[tuple[np.ndarray, ...]] = []
    carried: int | None = None  # the hub of a list that began in rows that are gone

    def changes(*columns: np.ndarray) -> np.ndarray:
        return np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]

    def summed(u: list[np.ndarray], v: list[np.ndarray], by_v: int) -> tuple[np.ndarray, ...]:
        """(u, v, n) of the pairs of places in two sorted arrays, the second of ``by_v`` items; a pair is sorted as one number."""
        packed = np.concatenate([x * by_v + y for x, y in zip(u, v)]) if u else np.empty(0, np.int64)
        packed.sort()
        first = np.flatnonzero(changes(packed)) if len(packed) else np.empty(0, np.int64)
        n = np.diff(np.r_[first, len(packed)])
        packed = packed[first]
        return packed // by_v, packed % by_v, n

    def found(a: np.ndarray, s: np.ndarray, part: np.ndarray, hub: int | None) -> pa.RecordBatch:
        once = changes(s, part, a)  # copies that other tasks have read
        a, s, part = a[once], s[once], part[once]
        starts = np.flatnonzero(changes(s, part))
        length = np.diff(np.r_[starts, len(s)])
        long = (length > short_list) | (part[starts] > 0)
        long[0] |= hub is not None
        hubs = ((a[starts].view(np.uint64) + length.astype(np.uint64)) * _MIX).view(np.int64)
        if hub is not None:
            hubs[0] = hub
        texts, place = np.unique(a, return_inverse=True)
        ones: list[np.ndarray] = []
        others: list[np.ndarray] = []
        for k in np.unique(length[~long]):
            if k > 1:
                members = place[starts[~long & (length == k)][:, None] + np.arange(k)]
                i, j = np.triu_indices(k, 1)
                ones.append(members[:, j].ravel())
                others.append(members[:, i].ravel())
        u, v, n = summed(ones, others, len(texts))
        rows = [((texts[u], texts[v], n), PAIR)]
        inside = np.repeat(long, length)
        own_hubs, hub_place = np.unique(hubs, return_inverse=True)
        u, v, n = summed([place[inside]], [np.repeat(hub_place, length)[inside]], len(own_hubs))
        rows.append(((texts[u], own_hubs[v], n), HOOK))
        headed = part[starts] > 0
        rows.append(((s[starts][headed], hubs[headed], np.ones(int(headed.sum()), np.int64)), HEAD))
        columns = [pa.array(np.concatenate([r[i] for r, _ in rows]).astype(np.int64, copy=False)) for i in range(3)]
        kinds = pa.array(np.concatenate([np.full(len(r[0]), kind, np.int32) for r, kind in rows]))
        return pa.RecordBatch.from_arrays([columns[0], columns[1], kinds, columns[2]], ["u", "v", "kind", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "s", "part")))
        if sum(len(h[0]) for h in held) < 250_000:
            continue
        a, s, part = (np.concatenate(x) for x in zip(*held))
        last = int(np.flatnonzero(changes(s, part))[-1])
        if last:
            yield found(a[:last], s[:last], part[:last], carried)
            held, carried = [(a[last:], s[last:], part[last:])], None
        else:  # one list and no end yet: hook what is there, and keep its hub
            carried = int(s[0]) if carried is None else carried
            yield found(a, s, part, carried)
            held = [(a[-1:], s[-1:], part[-1:])]
    if held:
        yield found(*(np.concatenate(x) for x in zip(*held)), carried)


def heap_merge(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(item, n) of the items that ``least`` of the sorted lists have, in order, by a heap of the lists' heads.

    Where too few lists have the least item, further heads are popped until only one fewer than ``least`` are missing from the heap; those
    lists skip by binary search to the head that is left, as no item before it can be in enough of them.
    """
    k = len(lists)
    at = [0] * k
    heap = [x[0] * k + i for i, x in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0] // k, []
        while heap and heap[0] // k == top:
            popped.append(heappop(heap) % k)
        if len(popped) >= least:
            yield top, len(popped)
            for i in popped:
                at[i] += 1
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heappop(heap) % k)
            if not heap:
                return
            bound = heap[0] // k
            for i in popped:
                at[i] = bisect_left(lists[i], bound, at[i])
        for i in popped:
            if at[i] < len(lists[i]):
                heappush(heap, lists[i][at[i]] * k + i)


#: Up to so many lists are merged by the heap, item by item in Python; more of them are merged as arrays, at a small part of the cost of an item.
HEAP_LISTS = 4


def merged(postings: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The items that ``least`` of the sorted lists ``postings[start:end]`` have, in order, and how many of the lists have each."""
    if len(starts) <= HEAP_LISTS:
        pairs = list(heap_merge([postings[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist())], least))
        return np.array([x for x, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)
    sizes = ends - starts
    items = np.sort(postings[np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)], kind="stable")
    if least > len(items):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # An item has ``least`` lists if it is met again so many places later.
    able = np.unique(items[: len(items) - least + 1][items[: len(items) - least + 1] == items[least - 1 :]]) if least > 1 else np.unique(items)
    return able.astype(np.int64), np.searchsorted(items, able, "right") - np.searchsorted(items, able, "left")


class CellIndex:
    """The inverted lists of some sets, and T-occurrence search over them."""

    def __init__(self, sets: list[np.ndarray], percent: int, weight: float = 1.0):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.percent, self.weight = percent, weight
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.postings = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        flat = flat[order]
        self.starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        self.ends = np.r_[self.starts[1:], len(flat)]
        self.keys = flat[self.starts]
        self.places: np.ndarray | None = None  # of the postings: list, then set

    def search(self, query: np.ndarray, before: int | None = None) -> np.ndarray:
        """The sets that link with a sorted set, itself among them if it is there; only the first ``before`` sets, if given.

        DivideSkip: of the query's lists, the L longest are put aside; a set with T shingles in common is in T - L of the short lists at
        least. The short lists are merged, and what is in enough of them is probed for in the long ones. L follows
        from T and the longest list's length.
        """
        size = len(query)
        least = required(size, self.percent)
        own = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        own = own[self.keys[own] == query]
        if len(own) < least:
            return np.empty(0, np.int64)
        starts, ends = self.starts[own], self.ends[own]
        if before is not None:
            n = len(self.sizes)
            if self.places is None:
                self.places = np.repeat(np.arange(len(self.keys)), self.ends - self.starts) * n + self.postings
            ends = np.searchsorted(self.places, own * n + before)
            some = ends > starts
            starts, ends = starts[some], ends[some]
            if len(starts) < least:
                return np.empty(0, np.int64)
        order = np.argsort(ends - starts, kind="stable")
        longest = int((ends - starts)[order[-1]])
        aside = min(least - 1, int(least / (self.weight * math.log2(longest + 1) + 1)))
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        found, counts = merged(self.postings, starts[short], ends[short], least - aside)
        # The overlap that the two sizes ask for.
        need = -(-self.percent * (size + self.sizes[found]) // (100 + self.percent))
        able = (need <= size) & (need <= self.sizes[found])
        found, counts, need = found[able], counts[able], need[able]
        for left, k in zip(range(len(long), 0, -1), long.tolist()):
            able = counts + left >= need
            if not able.all():
                found, counts, need = found[able], counts[able], need[able]
            if not len(found):
                break
            probed = self.postings[starts[k] : ends[k]]
            at = np.minimum(np.searchsorted(probed, found), len(probed) - 1)
            counts = counts + (probed[at] == found)
        return found[counts >= need]


def link_cell(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least index in each set's component of links.

    Queries are the sets outside the largest component: a link between two components has an end in one
    of those, so when all of them have been searched, no link between components is left.
    """
    n = len(sets)
    parent, weight = list(range(n)), [1] * n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = CellIndex(sets, percent)
    largest = 0
    pending = list(range(n))
    while True:
        waiting = []
        for q in pending:
            root = find(q)
            if root == find(largest) and weight[root] > 1:
                waiting.append(q)
                continue
            for other in index.search(sets[q]).tolist():
                a, b = find(q), find(other)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
                    weight[a] += weight[b]
                    if weight[a] > weight[find(largest)]:
                        largest = a
        if len(waiting) == len(pending) or not any(find(q) != find(largest) for q in waiting):
            break
        pending = waiting
    return np.array([find(x) for x in range(n)])


Held = tuple[tuple, np.ndarray]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[Held]]]:
    """Rows sorted by ``keys``, group by group: the key, and the rows' ``columns`` with their shingles, one after the other."""

    def rows() -> Iterator[tuple[tuple, tuple, np.ndarray]]:
        for batch in batches:
            at = np.asarray(batch.column("shingles").offsets).tolist()
            flat = batch.column("shingles").values.to_numpy(zero_copy_only=False).view(np.uint64)
            named = zip(*(batch.column(c).to_pylist() for c in keys))
            for i, (key, row) in enumerate(zip(named, zip(*(batch.column(c).to_pylist() for c in columns)))):
                yield key, row, flat[at[i] : at[i + 1]].copy()

    for key, group in groupby(rows(), lambda r: r[0]):
        yield key, ((row, shingles) for _, row, shingles in group)


def in_batches(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers as batches."""
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names)


def link_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, root) of the sets of whole cells; the root is the component's least id."""
    for _, rows in by_group(batches, ["cell"], ["id", "a", "b"]):
        held = sorted(rows, key=lambda h: h[0])
        held = [h for i, h in enumerate(held) if not i or h[0] != held[i - 1][0]]  # rows that repeat id and text
        root = link_cell([s for _, s in held], percent) if len(held) > 1 else [0]
        for (_, a, b), r in zip((h for h, _ in held), root):
            yield a, b, held[r][0][0]


#: What a row of a slice is: an indexed set, one that also asks, or one that only asks and is indexed in another slice.
INDEXED, BOTH, ASKS = 0, 1, 2


def link_slices(batches: Iterator[pa.RecordBatch], percent: int, ranked: bool) -> Iterator[tuple[int, int]]:
    """(u, v): links of a slice's queries with its indexed sets, one to each other root. Rows that only ask come last.

    ``ranked``: roots are ordered by the number ``k`` of their sets, the largest first, and a set is searched for only in the sets of roots
    before its own, so that the sets of a large group are not found again for each of its sets.
    """

    def rank(held: Held) -> tuple[int, int]:
        return -held[0][3], -held[0][2]

    for _, rows in by_group(batches, ["cell", "slice"], ["role", "a", "root", "k"]):
        held: list[Held] = []
        asking: list[Held] = []
        for row, shingles in rows:
            if row[0] == ASKS:
                asking.append((row, shingles))
                break
            held.append((row, shingles))
        if not held:
            continue
        held.sort(key=rank)
        ranks = [rank(h) for h in held]
        index: CellIndex | None = None
        for row, shingles in chain((h for h in held if h[0][0] == BOTH), asking, rows):
            index = index or CellIndex([s for _, s in held], percent)
            before = bisect_left(ranks, rank((row, shingles))) if ranked else None
            linked = {held[i][0][2]: held[i][0][1] for i in index.search(shingles, before).tolist()}
            for root, a in linked.items():
                if root != row[2]:
                    yield row[1], a


def jaccard_components(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text",
    order_docs: int = 16_384, order_shingles: int = 100_000, frequent: int = 16, cut: float = 0.35, short_list: int = 24, cell_shingles: int = 100_000, wide_shingles: int = 2_000_000, pivots: int = 8,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Two texts link when their shingle sets' Jaccard similarity is ``percent`` per cent at least;
    component_id is the least id that links reach. Null, empty and wordless texts have no shingles and
    link with nothing; texts of fewer words than a shingle are one shingle. A row without id keeps a null
    component and links with nothing. Rows that repeat an id are judged by their texts. An empty table
    gives no rows.

    ``order_docs`` texts are sampled; at most ``order_shingles`` of the shingles that ``frequent`` of these share
    are tried last. That and ``cut``, the share of other shingles that is tried, decide only how many candidates
    there are, never the result. Lists of up to
    ``short_list`` texts count pairs, longer ones hook. A cell of up to ``cell_shingles`` shingles is searched by one task. The sets of a larger one
    are dealt to slices of half as many, and about ``pivots`` of them are searched for in all slices; then every set outside the largest
    component that this gives is searched for in slices of ``wide_shingles``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def whole_sets(batches: Iterator[pa.RecordBatch], distinct: bool = False) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        seen: set[tuple[int, int]] = set()
        for part in steps(batches, "text"):
            sets = shingler.sets(part.column("text").to_pylist())
            marks = [digest(s) for s in sets]
            if distinct:
                own = [i for i, m in enumerate(marks) if m not in seen and not seen.add(m)]
                part, sets, marks = part.take(pa.array(own, pa.int64())), [sets[i] for i in own], [marks[i] for i in own]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), lists(sets)], ["id", "a", "b", "shingles"]
            )

    set_type = "id long, a long, b long, shingles array<long>"
    total = rows.count()
    share = min(1.0, order_docs / max(1, total))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 11) / F.lit(float(1 << 53))
    sampled = rows.where(draw < share).mapInArrow(sparing(lambda batches: whole_sets(batches, distinct=True)), set_type)
    common = sampled.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= frequent).orderBy(F.desc("n"), "s").limit(order_shingles)
    ranked = sorted((np.int64(r["s"]).view(np.uint64), r["n"]) for r in common.collect())
    hot, hot_count = np.array([k for k, _ in ranked], np.uint64), np.array([n for _, n in ranked], np.int64)
    below = np.uint64(int(cut * 2**64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        seen: set[int] = set()  # sets of this task, whose prefix has been given for a row with an id
        none = np.empty(0, np.uint64)
        for part in steps(batches, "text"):
            sets = shingler.sets(part.column("text").to_pylist())
            marks, rare, often = [digest(s) for s in sets], [], []
            for row, s, (a, _) in zip(part.column("id").to_pylist(), sets, marks):
                if row is None or a in seen or not len(s):
                    rare.append(none)
                    often.append(none)
                    continue
                seen.add(a)
                want = len(s) - required(len(s), percent) + 1
                at = np.searchsorted(hot, s)
                at[at == len(hot)] = 0
                is_hot = hot[at] == s if len(hot) else np.zeros(len(s), bool)
                own, rest = s[~is_hot], s[is_hot]
                # At least the prefix that shares a shingle with whatever links; the cut if that is more.
                rare.append(own[: max(want, int(np.searchsorted(own, below)))])
                often.append(rest[np.lexsort((rest, hot_count[at[is_hot]]))][: want - len(own)] if len(own) < want else none)
            taken = [int(np.searchsorted(x, below)) for x in rare]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(taken, pa.int64()), lists(rare), lists(often)],
                ["id", "a", "b", "n", "taken", "rare", "often"],
            )

    marked = materialize(rows.mapInArrow(sparing(prefixes), "id long, a long, b long, n long, taken long, rare array<long>, often array<long>"), "join-marks")
    listed = marked.where("id IS NOT NULL").select("a", F.explode("rare").alias("s"), F.lit(0).alias("part")).union(
        marked.where("id IS NOT NULL").select("a", F.explode("often").alias("s"), (F.pmod("a", F.lit(64)) + 1).cast("int").alias("part"))
    )
    dealt = listed.repartition("s", "part").sortWithinPartitions("s", "part", "a")
    hooks = materialize(dealt.mapInArrow(sparing(lambda batches: hook_lists(batches, short_list)), "u long, v long, kind int, n long"), "join-hooks")
    groups = marked.where("id IS NOT NULL AND n > 0").groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("taken").alias("taken"))
    # What any partner must share with a text below the cut; less than 1: one shared shingle of the prefix is all that can be asked for.
    sizes = groups.groupBy("a").agg(F.max("n").alias("n"), F.max("taken").alias("taken")).withColumn("least_shared", F.col("taken") - F.col("n") + F.ceil(F.col("n") * percent / 100))
    in_long = hooks.where(F.col("kind") == HOOK).groupBy("u").agg(F.sum("n").alias("long"))
    known = materialize(sizes.join(in_long.withColumnRenamed("u", "a"), "a", "left").na.fill(0, ["long"]), "join-sizes")

    def side(name: str) -> DataFrame:
        return known.select(F.col("a").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "taken", "least_shared", "long")])

    counted = hooks.where(F.col("kind") == PAIR).groupBy("u", "v").agg(F.sum("n").alias("shared")).join(side("u"), "u").join(side("v"), "v")
    # Above the cut a pair shares as many as either text has left, and in long lists as many as either text has there.
    most = F.col("shared") + F.least("long_u", "long_v") + F.least(F.col("n_u") - F.col("taken_u"), F.col("n_v") - F.col("taken_v"))
    loose = F.least("least_shared_u", "least_shared_v") < 1
    fits = (100 + percent) * F.least(F.when(loose, F.least("n_u", "n_v")).otherwise(most), "n_u", "n_v") >= percent * (F.col("n_u") + F.col("n_v"))
    near = counted.where(fits).select("u", "v")
    hooked = hooks.where(F.col("kind") == HOOK).join(known.select(F.col("a").alias("u"), "least_shared", "long"), "u").where("long >= least_shared").select("u", "v").distinct()
    # Lists of frequent shingles came in 64 parts; their heads meet here.
    heads = hooks.where(F.col("kind") == HEAD).select(F.col("u").alias("s"), F.col("v").alias("m")).distinct()
    far = heads.join(heads.groupBy("s").agg(F.min("m").alias("v")), "s").where("m <> v").select(F.col("m").alias("u"), "v")
    near = near.union(hooked).union(far)
    stars = components(near, "join-cells")
    # Hubs are nodes too; they drop out here, as no text has their number.
    cells = stars.select(F.col("node").alias("a"), F.col("root").alias("cell")).union(stars.select(F.col("root").alias("a"), F.col("root").alias("cell")).distinct())

    members = materialize(groups.join(cells, "a").select("a", "b", F.col("least").alias("id"), "n", "cell"), "join-members")
    size = members.groupBy("cell").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    size = size.withColumn("slices", F.when(F.col("shingles") > cell_shingles, F.ceil(2 * F.col("shingles") / cell_shingles)).otherwise(1).cast("int"))
    size = size.select("cell", "slices", F.ceil(F.col("shingles") / wide_shingles).cast("int").alias("parts"), F.col("sets").alias("in_cell"), "sets")
    drawn = F.shiftrightunsigned(F.xxhash64("a", F.lit(7)), 11) / F.lit(float(1 << 53))
    wanted = join_split(members, size, ["cell"], "sets", total).select(
        "id", F.col("a").alias("wa"), F.col("b").alias("wb"), "cell", "slices", "parts", (drawn * F.col("in_cell") < pivots).alias("pivot")
    )
    wanted = materialize(wanted, "join-wanted")

    def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the texts that are the wanted ones: ids may repeat."""
        shingler = Shingler(words)
        for part in steps(batches, "text"):
            sets = shingler.sets(part.column("text").to_pylist())
            own = [i for i, (s, *w) in enumerate(zip(sets, part.column("wa").to_pylist(), part.column("wb").to_pylist())) if digest(s) == tuple(w)]
            part = part.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("cell", "slices", "parts", "pivot", "id", "wa", "wb")] + [lists([sets[i] for i in own])], ["cell", "slices", "parts", "pivot", "id", "a", "b", "shingles"])

    found = may_be_in(rows, wanted, "id").join(wanted, "id").mapInArrow(sparing(wanted_sets), "cell long, slices int, parts int, pivot boolean, id long, a long, b long, shingles array<long>")
    has_wide = wanted.where("slices > 1").limit(1).count() > 0
    if has_wide:
        found = materialize(found, "join-sets")
    dealt = found.where("slices = 1").repartition("cell").sortWithinPartitions("cell")
    linked = materialize(dealt.mapInArrow(sparing(lambda batches: in_batches(link_groups(batches, percent), ["a", "b", "root"])), "a long, b long, root long"), "join-links")
    if has_wide:
        linked = linked.union(_wide_cells(found.where("slices > 1"), percent, total))
    classes = groups.join(linked, ["a", "b"], "left").where("copies > 1 OR root IS NOT NULL").select("a", "b", F.coalesce("root", "least").alias("component"), "copies")
    able = F.col("id").isNotNull() & (F.col("n") > 0)
    judged = join_split(marked.where(able).select("id", "a", "b", "n"), materialize(classes, "join-classes"), ["a", "b"], "copies", total, "left")
    judged = judged.select("id", "n", F.coalesce("component", "id").alias("component")).unionByName(marked.where(~able).select("id", "n", F.col("id").alias("component")))
    return judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _wide_cells(sets: DataFrame, percent: int, total: int) -> DataFrame:
    """(a, b, root) of the sets (cell, slices, pivot, id, a, b, shingles) of cells that no single task searches; the root is the component's least id.

    A set is indexed in one slice. Pivots first link with whatever they reach in all slices; a link between two components then has an end
    outside the cell's largest one, so only those sets are searched for, in fewer and larger slices.
    """

    def searched(held: DataFrame, slices: Column, asks: Column, ranked: bool) -> DataFrame:
        """Links of those sets of ``held`` (cell, a, root, k, shingles) that ask with all of their cell, or with the roots ranked before theirs."""
        at = F.pmod(F.xxhash64("a"), slices).cast("int")
        own = F.struct(at.alias("slice"), F.when(asks, BOTH).otherwise(INDEXED).alias("role"))
        others = F.transform(F.filter(F.sequence(F.lit(0), slices - 1), lambda s: s != at), lambda s: F.struct(s.cast("int").alias("slice"), F.lit(ASKS).alias("role")))
        dealt = held.select("cell", "a", "root", "k", "shingles", F.explode(F.when(asks, F.concat(F.array(own), others)).otherwise(F.array(own))).alias("x"))
        dealt = dealt.select("cell", "x.slice", "x.role", "a", "root", "k", "shingles").repartition("cell", "slice").sortWithinPartitions("cell", "slice", "role", "a")
        return dealt.mapInArrow(sparing(lambda batches: in_batches(link_slices(batches, percent, ranked), ["u", "v"])), "u long, v long")

    first = materialize(searched(sets.withColumns({"root": F.col("a"), "k": F.lit(1).cast("long")}), F.col("slices"), F.col("pivot"), ranked=False), "join-pivots")
    stars = components(first, "join-stars").withColumnRenamed("node", "a")
    once = materialize(sets.groupBy("cell", "a", "b").agg(F.min("id").alias("id")), "join-wide")
    known = materialize(once.join(stars, "a", "left").select("cell", "a", F.coalesce("root", "a").alias("root")), "join-known")
    of_root = known.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("k"))
    top = of_root.groupBy("cell").agg(F.max(F.struct("k", "root")).alias("x"), F.sum("k").alias("sets")).select("cell", F.col("x.root").alias("top"), (F.col("sets") - F.col("x.k")).alias("others"), "sets")
    known = join_split(known, of_root.withColumn("n", F.col("k")), ["cell", "root"], "n", total)
    known = materialize(join_split(known, top, ["cell"], "sets", total).where("others > 0").select("cell", "a", "root", "k", (F.col("root") != F.col("top")).alias("asks")), "join-rest")
    links = first.union(searched(sets.join(known, ["cell", "a"]), F.col("parts"), F.col("asks"), ranked=True))
    nodes = components(links, "join-tops").withColumnRenamed("node", "a")
    placed = once.join(nodes, "a", "left").select("a", "b", "id", F.coalesce("root", "a").alias("top"))
    least = placed.groupBy("top").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("sets"))
    return join_split(placed, least, ["top"], "sets", total).select("a", "b", "root")
