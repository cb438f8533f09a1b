"""Cheapest join paths from groups of starts, each in a task that holds what lies near them.

A group's task gets the edges that leave tables within the reach of its starts, with their names,
and searches for all of them in numpy, so that neither the ways on the way nor the paths found
are ever shuffled. Searches are those of kshortest.py: labels with dominance, and Yen's detours
for all pairs of a batch of starts at once. Edges stand in the order of their table and
signature, so ways compare like signatures; edges that differ in confidence alone are edges
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = ("a", "ac", "b", "bc", "kind", "conf")
FOUND = "from_table string, to_table string, rank int, hops int, inf int, cost long, steps array<struct<a:string,ac:string,b:string,bc:string,kind:string,conf:double>>"
#: starts that are searched for at once; ways that a step of theirs may have (else fewer starts)
BATCH, ROOM = 256, 1 << 22
#: rows of a batch of results
ROWS = 1 << 15
_FAR = np.int64(1) << 40


class _TooMany(Exception):
    """A batch of several starts has more ways than ROOM."""


@dataclass(frozen=True)
class Limits:
    k: int
    depth: int
    inferred: int
    #: whether goals are told (as pairs, or as tables marked); else every table is one
    goals: bool


@dataclass(frozen=True)
class Tasks:
    """Searches as in kshortest.relax; goal, avoid and skip are padded with -1."""

    start: np.ndarray
    inf_left: np.ndarray
    goal: np.ndarray | None = None
    avoid: np.ndarray | None = None
    skip: np.ndarray | None = None
    hops_left: np.ndarray | None = None


@dataclass(frozen=True)
class Ways:
    """Ways (places of edges, padded with -1) with their task, last table and costs."""

    task: np.ndarray
    node: np.ndarray
    hops: np.ndarray
    inf: np.ndarray
    cost: np.ndarray
    way: np.ndarray

    def __getitem__(self, at: np.ndarray | slice) -> Ways:
        return Ways(self.task[at], self.node[at], self.hops[at], self.inf[at], self.cost[at], self.way[at])

    def first(self, *keys: np.ndarray) -> Ways:
        """The first of each key by cost, hops, signature."""
        order = np.lexsort((*self.way.T[::-1], self.hops, self.cost, *keys))
        return self[order[_new(*(k[order] for k in keys))]]


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _joined(parts: list[Ways]) -> Ways:
    return Ways(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("task", "node", "hops", "inf", "cost", "way")))


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places from begin on, count for each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - (np.cumsum(count) - count)[row] + begin[row]


class Near:
    """The edges of a group: steps, table numbers, and where a table's edges begin."""

    def __init__(self, edges: pa.Table):
        ends = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks().dictionary_encode()
        self.names = ends.dictionary
        number = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        src, dst = number[: len(edges)], number[len(edges) :]
        sig = pc.binary_join_element_wise(edges["a"], ".", edges["ac"], "=", edges["b"], ".", edges["bc"], ":", edges["kind"], "").cast(pa.binary())
        order = pc.sort_indices(pa.table({"src": src, "sig": sig, "conf": edges["conf"]}), [("src", "ascending"), ("sig", "ascending"), ("conf", "ascending")]).to_numpy()
        edges = edges.take(pa.array(order))
        self.src, self.dst = src[order], dst[order]
        self.begin = np.searchsorted(self.src, np.arange(len(self.names) + 1))
        self.cost = edges["cost"].to_numpy().astype(np.int64)
        self.inf = pc.equal(edges["kind"], "inferred").to_numpy().astype(np.int64)
        self.steps = pa.StructArray.from_arrays([edges[c].combine_chunks() for c in STEP], list(STEP))
        self.marked = np.zeros(len(self.names), dtype=bool)
        self.marked[self.dst[edges["marked"].to_numpy()]] = True
        back = np.argsort(self.dst, kind="stable")
        self.back, self.back_begin = self.src[back], np.searchsorted(self.dst[back], np.arange(len(self.names) + 1))

    def numbers(self, names: pa.Array) -> np.ndarray:
        """Numbers of tables, -1 for those without edges here."""
        return pc.fill_null(pc.index_in(names, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def labels(self, tasks: Tasks, limits: Limits, many: int, within: tuple[np.ndarray, np.ndarray] | None = None) -> Ways:
        """Ways that no other of their task and table makes useless; many: the batch's starts."""
        size = len(self.names)
        none = np.zeros(len(tasks.start), dtype=np.int64)
        front = Ways(np.arange(len(none)), tasks.start, none, none, none, np.full((len(none), limits.depth), -1, dtype=np.int32))
        key, inf, cost, found = front.task * size + front.node, none, none, [front[:0]]
        for h in range(limits.depth):
            if tasks.goal is not None:
                front = front[front.node != tasks.goal[front.task]]
            row, e = self._steps_from(front.node, many)
            x_task, x_node, x_inf = front.task[row], self.dst[e], front.inf[row] + self.inf[e]
            ok = (x_node != tasks.start[x_task]) & (x_inf <= tasks.inf_left[x_task])
            if tasks.goal is not None:
                ok &= (h + 1 <= tasks.hops_left[x_task]) & ~(tasks.avoid[x_task] == x_node[:, None]).any(axis=1)
                if h == 0:
                    ok &= ~(tasks.skip[x_task] == e[:, None]).any(axis=1)
            if within is not None:
                ok[ok] = _least(within, tasks.goal[x_task[ok]] * size + x_node[ok]) + h + 1 <= tasks.hops_left[x_task[ok]]
            row, e, x_task, x_node, x_inf = row[ok], e[ok], x_task[ok], x_node[ok], x_inf[ok]
            way = front.way[row]
            way[:, h] = e
            new = Ways(x_task, x_node, np.full(len(row), h + 1), x_inf, front.cost[row] + self.cost[e], way)
            new = new.first(new.inf, new.task * size + new.node)
            # the least cost of the rows before, older ones first, tells what is useless
            keys, infs, costs = np.concatenate([key, new.task * size + new.node]), np.concatenate([inf, new.inf]), np.concatenate([cost, new.cost])
            fresh = np.arange(len(keys)) >= len(key)
            order = np.lexsort((fresh, infs, keys))
            below = costs[order] - np.cumsum(_new(keys[order])) * _FAR
            least = np.minimum.accumulate(below)
            useful = np.ones(len(keys), dtype=bool)
            useful[order[1:]] = least[:-1] > below[1:]
            front = new[useful[len(key) :]]
            if not len(front.task):
                break
            found.append(front)
            key, inf, cost = np.concatenate([key, front.task * size + front.node]), np.concatenate([inf, front.inf]), np.concatenate([cost, front.cost])
        return _joined(found)

    def _steps_from(self, node: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        count = self.begin[node + 1] - self.begin[node]
        if many > 1 and count.sum() > ROOM:
            raise _TooMany
        return _spread(self.begin[node], count)

    def hops_to(self, goals: np.ndarray, depth: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(goal and table as one number, hops between them), in order, up to depth."""
        size = len(self.names)
        key, hops = np.unique(goals * size + goals), np.zeros(len(goals), dtype=np.int64)
        front = key
        for h in range(1, depth + 1):
            goal, node = front // size, front % size
            count = self.back_begin[node + 1] - self.back_begin[node]
            if many > 1 and count.sum() > ROOM:
                raise _TooMany
            row, at = _spread(self.back_begin[node], count)
            front = np.unique(goal[row] * size + self.back[at])
            front = front[_least((key, hops), front) >= _FAR]
            key, hops = np.concatenate([key, front]), np.concatenate([hops, np.full(len(front), h)])
            order = np.argsort(key, kind="stable")
            key, hops = key[order], hops[order]
        return key, hops

    def search(self, starts: np.ndarray, pairs: np.ndarray | None, limits: Limits) -> list[tuple[int, np.ndarray, Ways]]:
        """(rank, start, ways) of the paths from starts; pairs: start and goal as one number."""
        size = len(self.names)
        found = self.labels(Tasks(starts, np.full(len(starts), limits.inferred)), limits, len(starts))
        if limits.goals:
            found = found[self.marked[found.node] if pairs is None else np.isin(starts[found.task] * size + found.node, pairs)]
        last = found.first(found.node, found.task)
        out = [(1, starts[last.task], last)]
        if limits.k == 1 or not len(last.task):
            return out
        start, goal = starts[last.task], last.node
        within = self.hops_to(np.unique(goal), limits.depth - 1, len(starts))
        last = replace(last, task=np.arange(len(last.task)))  # from here on a task is a pair
        accepted = np.full((len(start), limits.k, limits.depth), -1, dtype=np.int32)
        accepted[:, 0] = last.way
        waiting = last[:0]
        for rank in range(2, limits.k + 1):
            waiting = _joined([waiting, self._detours(last, goal, accepted, rank, within, limits, len(starts))])
            waiting = waiting.first(*waiting.way.T, waiting.task)
            last = waiting.first(waiting.task)
            if not len(last.task):
                break
            accepted[last.task, rank - 1] = last.way
            out.append((rank, start[last.task], last))
            waiting = waiting[(waiting.way != accepted[waiting.task, rank - 1]).any(axis=1)]
        return out

    def _detours(self, last: Ways, goal: np.ndarray, accepted: np.ndarray, rank: int, within: tuple, limits: Limits, many: int) -> Ways:
        """The cheapest way on from each table of the last paths but their ends."""
        row, i = _spread(np.zeros(len(last.task), dtype=np.int64), last.hops)
        way, pair, place = last.way[row], last.task[row], np.arange(limits.depth)
        root = np.where(place < i[:, None], way, -1)
        told = root >= 0
        avoid = np.where(told, self.src[root], -1)
        at = self.src[way[np.arange(len(row)), i]]
        others = accepted[pair, : rank - 1]
        same = ((others == root[:, None]) | (place >= i[:, None])[:, None]).all(axis=2)
        skip = np.where(same, np.take_along_axis(others, np.broadcast_to(i[:, None, None], (*others.shape[:2], 1)), axis=2)[:, :, 0], -1)
        root_inf, root_cost = (np.where(told, x[root], 0).sum(axis=1) for x in (self.inf, self.cost))
        found, step = [], max(1, ROOM // 64)
        for a in range(0, len(row), step):
            own = slice(a, a + step)
            tasks = Tasks(at[own], limits.inferred - root_inf[own], goal[pair[own]], avoid[own], skip[own], limits.depth - i[own])
            x = self.labels(tasks, limits, many, within)
            x = x[x.node == tasks.goal[x.task]]
            x = x.first(x.task)
            found.append(replace(x, task=x.task + a))
        x = _joined(found) if found else last[:0]
        spur = x.task
        moved = place - i[spur, None]
        whole = np.where(moved < 0, root[spur], np.take_along_axis(x.way, np.maximum(moved, 0), axis=1))
        return Ways(pair[spur], x.node, x.hops + i[spur], x.inf + root_inf[spur], x.cost + root_cost[spur], whole)

    def told(self, rank: int, start: np.ndarray, ways: Ways) -> Iterator[pa.RecordBatch]:
        """Rows of FOUND."""
        for a in range(0, len(start), ROWS):
            x, own = ways[slice(a, a + ROWS)], start[a : a + ROWS]
            ends = np.concatenate([[0], np.cumsum(x.hops)]).astype(np.int32)
            steps = pa.ListArray.from_arrays(pa.array(ends), self.steps.take(pa.array(x.way[x.way >= 0])))
            columns = [self.names.take(pa.array(own)), self.names.take(pa.array(x.node)), pa.array(np.full(len(own), rank, dtype=np.int32)), pa.array(x.hops.astype(np.int32)), pa.array(x.inf.astype(np.int32)), pa.array(x.cost), steps]
            yield pa.RecordBatch.from_arrays(columns, ["from_table", "to_table", "rank", "hops", "inf", "cost", "steps"])


def _least(within: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The hops of each key, _FAR where it has none."""
    keys, hops = within
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, hops[at], _FAR)


def searched(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows (p, role, STEP, cost, marked) sorted by p; role 0: a start (a), and its goal (b) if
    pairs are told; role 1: an edge."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        p = batch.column("p").to_numpy(zero_copy_only=False)
        border = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
        for i, j in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if i == j:
                continue
            if held and held[-1].column("p")[0].as_py() != p[i]:
                yield from _group(held, limits)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield from _group(held, limits)


def _group(held: list[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    held.clear()
    is_edge = pc.equal(rows["role"], 1)
    told, edges = rows.filter(pc.invert(is_edge)), rows.filter(is_edge)
    if not len(edges):
        return
    near = Near(edges)
    del rows, edges
    start, goal = near.numbers(told["a"].combine_chunks()), near.numbers(told["b"].combine_chunks())
    pairs = np.unique((start * len(near.names) + goal)[(start >= 0) & (goal >= 0)]) if limits.goals and told["b"].null_count < len(told) else None
    starts = np.unique(start[start >= 0])
    left = [starts[i : i + BATCH] for i in range(0, len(starts), BATCH)]
    while left:
        batch = left.pop()
        try:
            found = near.search(batch, pairs, limits)
        except _TooMany:
            left += [batch[: len(batch) // 2], batch[len(batch) // 2 :]]
            continue
        for one in found:
            yield from near.told(*one)
