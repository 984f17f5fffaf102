"""Fill containers of fixed capacity with items, leaving as little space unused as can be.

The plan is made from the histogram of lengths alone, whose size is bounded by the
capacity, never by the number of items:

1. Items longer than the capacity are cut into full pieces and a rest; nothing
   else is split.
2. The configuration linear program (fewest containers so that every length class
   is covered; a column is a multiset of lengths that fits) is covered greedily with
   multiplicative weights, not solved to an accuracy: no column is taken back, and
   the end is no dual gap. Its gap is at most that to the volume bound, which is the
   dual value of weights in proportion to length. In a round a bounded knapsack, by
   dynamic programming over the capacity, prices the column of greatest weighted volume; it is taken as often as
   its scarcest class allows, and the weights of its classes shrink by
   exp(-rate * share covered). A class that is covered leaves the program, so that
   there are at most as many rounds as classes, which are the exact lengths. Over
   a capacity of 1,024 the knapsack works on a coarser grid, and the room lost by
   its rounding is filled again by an exact subset sum over the true lengths.
3. The solution is rounded down; what it leaves over is packed by repeated
   best-fit patterns, each the largest item and the exact best fill of its rest, of
   which there are again at most as many as classes.

Then the items are dealt to the planned places. An item's rank among those of its
length is its rank within its task plus the counts of the tasks before, so that a
length that a third of all items have is never gathered in one place.

Defined results: an item of size 0 or null takes no space; it keeps a row with a
null container and size 0. Items of equal length are interchangeable. An empty
table gives no rows. Keys need not be unique for the packing to be right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.runtime import cut_lineage


@dataclass
class Plan:
    """`patterns`: (lengths, copies of each, containers)."""

    capacity: int
    patterns: list[tuple[np.ndarray, np.ndarray, int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(times for _, _, times in self.patterns)


def _price(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Copies of each class in the best fill of `room`, at most `most` each."""
    bundles = []
    for i, (s, limit) in enumerate(zip(sizes.tolist(), np.minimum(most, room // sizes).tolist(), strict=True)):
        q = 1
        while limit > 0:
            q = min(q, limit)
            bundles.append((i, q, q * s))
            limit -= q
            q *= 2
    best = np.zeros(room + 1)
    taken = np.zeros((len(bundles), room + 1), bool)
    for k, (i, q, width) in enumerate(bundles):
        with_it = best[: room + 1 - width] + q * values[i]
        better = with_it > best[width:]
        taken[k, width:] = better
        best[width:] = np.where(better, with_it, best[width:])
    copies, left = np.zeros(len(sizes), np.int64), room
    for k in range(len(bundles) - 1, -1, -1):
        if taken[k, left]:
            i, q, width = bundles[k]
            copies[i] += q
            left -= width
    return copies


def _exact_fill(sizes: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Copies of each size, at most `most` each, whose sum comes closest to `room`; large sizes first.

    The sums in reach are the bits of an integer. It ends when the room is full; the
    bits kept for the way back are bounded, which matters for rooms of over 2**16.
    """
    copies = np.zeros(len(sizes), np.int64)
    fit = np.flatnonzero((sizes <= room) & (most > 0))[::-1]
    if not len(fit):
        return copies
    reach, mask, full = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int, int]] = []
    bound = max(64, (1 << 29) // (room + 1))
    for i, s, limit in zip(fit.tolist(), sizes[fit].tolist(), np.minimum(most[fit], room // sizes[fit]).tolist(), strict=True):
        q = 1
        while limit > 0:
            q = min(q, limit)
            more = (reach | reach << (q * s)) & mask
            if more != reach:
                steps.append((i, q, q * s, reach))
                reach = more
            limit -= q
            q *= 2
        if reach & full or len(steps) > bound:
            break
    at = reach.bit_length() - 1
    for i, q, width, before in reversed(steps):
        if not before >> at & 1:
            copies[i] += q
            at -= width
    return copies


def _column(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int, unit: int) -> np.ndarray:
    """Copies of each size in a fill of `capacity` of great value: priced on a grid of `unit`, then filled up exactly."""
    if unit == 1:
        return _price(sizes, values, most, capacity)
    grid, of = np.unique(-(-sizes // unit), return_inverse=True)
    stock = np.bincount(of, weights=most).astype(np.int64)
    chosen = _price(grid, np.bincount(of, weights=values * most) / stock, stock, capacity // unit)
    copies = np.zeros(len(sizes), np.int64)
    for c in np.flatnonzero(chosen):
        left = int(chosen[c])
        own = np.flatnonzero(of == c)
        for i in own[np.argsort(-most[own], kind="stable")]:
            copies[i] = min(left, most[i])
            left -= copies[i]
    if not copies.any():  # only sizes that are wider than the room by rounding
        copies[-1] = 1
    # Some of the smallest items, up to four, make way for an exact fill.
    best, rest, kept = copies, capacity - int(copies @ sizes), copies.copy()
    lost, room = rest, rest
    for _ in range(5):
        more = kept + _exact_fill(sizes, most - kept, room)
        if (now := capacity - int(more @ sizes)) < lost:
            best, lost = more, now
        inside = np.flatnonzero(kept)
        if lost == 0 or not len(inside):
            break
        kept[inside[0]] -= 1
        room += int(sizes[inside[0]])
    return best


def solve(counts: dict[int, int], capacity: int, grid: int = 1024, rate: float = 0.5, bias: float = 1.15) -> Plan:
    """The plan for `counts` items of each length from 1 to `capacity`.

    The knapsack's grid has at most `grid` steps, by which its cost doesn't depend
    on the capacity. A `bias` over 1 values large items above their volume, as
    small ones still fit at the end.
    """
    unit = -(-capacity // grid)
    plan = Plan(capacity)
    if whole := counts.get(capacity, 0):
        plan.patterns.append((np.array([capacity]), np.array([1]), whole))
    sizes = np.array(sorted(k for k, n in counts.items() if k < capacity and n > 0), np.int64)
    demand = np.array([counts[k] for k in sizes.tolist()], np.int64)
    need = demand.astype(float)
    volume = sizes.astype(float) ** bias
    covered = np.zeros(len(sizes))
    columns: dict[tuple[bytes, bytes], float] = {}
    while len(open_ := np.flatnonzero(covered < 1 - 1e-9)):
        weight = np.exp(-rate * covered[open_])
        copies = _column(sizes[open_], volume[open_] * weight, np.ceil((1 - covered[open_]) * need[open_]).astype(np.int64), capacity, unit)
        used = open_[copies > 0]
        copies = copies[copies > 0]
        amount = float(np.min((1 - covered[used]) * need[used] / copies))
        key = (used.tobytes(), copies.tobytes())
        columns[key] = columns.get(key, 0.0) + amount
        covered[used] += copies * amount / need[used]
    left = demand.copy()
    for (where, each), amount in columns.items():
        used, copies = np.frombuffer(where, np.int64), np.frombuffer(each, np.int64)
        times = int(min(np.floor(amount + 1e-6), np.min(left[used] // copies)))
        if times > 0:
            plan.patterns.append((sizes[used], copies, times))
            left[used] -= times * copies
    while len(rest := np.flatnonzero(left)):
        copies = _fill(sizes[rest], left[rest], capacity)
        used = rest[copies > 0]
        copies = copies[copies > 0]
        times = int(np.min(left[used] // copies))
        plan.patterns.append((sizes[used], copies, times))
        left[used] -= times * copies
    return plan


def _fill(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The largest item and what fills the rest of its container best."""
    most = left.copy()
    most[-1] -= 1
    copies = _exact_fill(sizes, most, room - int(sizes[-1]))
    copies[-1] += 1
    return copies


class Places:
    """Container of the item of each length and rank, by binary search in arrays bounded by the plan."""

    def __init__(self, plan: Plan, counts: dict[int, int]):
        self.span = 1 + max(counts.values(), default=0)
        rows, first, used = [], 0, {}
        for sizes, copies, times in plan.patterns:
            for s, q in zip(sizes.tolist(), copies.tolist(), strict=True):
                rows.append((s, used.get(s, 0), q, first))
                used[s] = used.get(s, 0) + q * times
            first += times
        rows.sort()
        self.keys = np.array([s * self.span + start for s, start, _, _ in rows], np.int64)
        self.start, self.each, self.first = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))

    def container(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, lengths * self.span + ranks, "right") - 1
        return self.first[at] + (ranks - self.start[at]) // self.each[at]


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the rank of each row among the task's rows of the same bin and size."""
    seen: dict[tuple[str, int], int] = {}
    task = TaskContext.get().partitionId()
    for batch in batches:
        bins = batch.column("bin").dictionary_encode()
        size = batch.column("size").to_numpy()
        code = bins.indices.to_numpy().astype(np.int64) << 40 | size
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        lengths = np.diff(np.concatenate([starts, [len(ordered)]]))
        names = bins.dictionary.to_pylist()
        base = []
        for c, n in zip(ordered[starts].tolist(), lengths.tolist(), strict=True):
            key = (names[c >> 40], c & ((1 << 40) - 1))
            base.append(seen.get(key, 0))
            seen[key] = base[-1] + n
        local = np.empty(len(code), np.int64)
        local[order] = np.arange(len(code)) - np.repeat(starts, lengths) + np.repeat(np.array(base, np.int64), lengths)
        yield batch.append_column("task", pa.array(np.full(len(code), task, np.int32))).append_column("local", pa.array(local))


def _pieces(items: DataFrame, key: str, size: str, bins: list[tuple[str, int]]) -> DataFrame:
    """(bin, key, part, start, size): every item cut to the capacity of each bin."""
    total = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(c).cast("bigint").alias("capacity")) for b, c in bins)))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("total") - 1) / F.col("b.capacity")), F.lit(0)).cast("bigint")))
    return (
        items.select(F.col(key).alias("key"), total.alias("total")).withColumn("b", each).withColumn("part", parts)
        .select("b.bin", "key", "part", (F.col("part") * F.col("b.capacity")).alias("start"),
                F.least("b.capacity", F.col("total") - F.col("part") * F.col("b.capacity")).alias("size"))
    )


def pack(items: DataFrame, key: str, size: str, bins: list[tuple[str, int]], max_capacity: int = 1 << 20) -> tuple[DataFrame, dict[str, Plan]]:
    """(bin, container, key, part, start, size) of every piece, and the plan of each bin.

    `bins` names the kinds of container with their capacities; containers are
    numbered from 0 within their kind. `start` is where the piece begins in its item.
    """
    if any(not 0 < c <= max_capacity for _, c in bins):
        raise ValueError(f"capacities must lie between 1 and {max_capacity}")
    kind = items.schema[key].dataType.simpleString()
    schema = f"bin string, key {kind}, part bigint, start bigint, size bigint"
    ranked = cut_lineage(_pieces(items, key, size, bins).mapInArrow(_local_ranks, schema + ", task int, local bigint"))
    sized = ranked.filter(F.col("size") > 0)
    tasks = sized.groupBy("bin", "size", "task").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[int, int]] = {b: {} for b, _ in bins}
    for r in tasks.groupBy("bin", "size").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        counts[r.bin][r.size] = r.n
    plans = {b: solve(counts[b], c) for b, c in bins}
    places = {b: Places(plans[b], counts[b]) for b in plans}
    earlier = F.sum("n").over(Window.partitionBy("bin", "size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks.select("bin", "size", "task", F.coalesce(earlier, F.lit(0)).alias("offset"))
    placed = ranked.join(offsets, ["bin", "size", "task"], "left").select("bin", "key", "part", "start", "size", (F.col("offset") + F.col("local")).alias("rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, length = np.array(batch.column("bin").to_pylist(), object), batch.column("size").to_numpy()
            rank = batch.column("rank").fill_null(0).to_numpy()
            found = np.zeros(len(length), np.int64)
            for b, p in places.items():
                mine = (bin_ == b) & (length > 0)
                if mine.any():
                    found[mine] = p.container(length[mine], rank[mine])
            numbers = pa.array(found, pa.int64(), mask=length == 0)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), numbers, *(batch.column(c) for c in ("key", "part", "start", "size"))], names=["bin", "container", "key", "part", "start", "size"])

    out = placed.mapInArrow(deal, f"bin string, container bigint, key {kind}, part bigint, start bigint, size bigint")
    return out.withColumnRenamed("key", key), plans
