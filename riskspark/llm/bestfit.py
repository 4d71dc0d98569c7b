"""Best-fit packing improved by local search: documents are exchanged between underfull bins until bins empty."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskspark.llm.common import text_rows
from riskspark.llm.packing import ByteBpe

SIZE = 1024
END_ID = 2
#: Tokens a task gathers before it packs them; bounds its memory (4 bytes each).
POOL = 1 << 22
#: Underfull bins it keeps open for what comes next, the emptiest ones.
OPEN_BINS = 1024

RESULT = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
          "doc_tokens long, ids array<int>")


def best_fit(sizes: np.ndarray, size: int, fills: list[int]) -> np.ndarray:
    """Bin of each item, largest item first, into the fullest bin it fits; ``fills`` holds the bins and grows."""
    at: list[list[int]] = [[] for _ in range(size + 1)]     # bins by fill
    held = np.zeros(size + 1, bool)
    for b, f in enumerate(fills):
        at[f].append(b)
        held[f] = True
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        room = held[: size - s + 1][::-1]
        f = size - s - int(room.argmax())
        if room.any():
            b = at[f].pop()
            held[f] = bool(at[f])
        else:
            f, b = 0, len(fills)
            fills.append(0)
        fills[b] = f + s
        at[f + s].append(b)
        held[f + s] = True
        out[i] = b
    return out


class Exchange:
    """Local search on the underfull bins: every step raises the sum of squared fills.

    A step takes the emptiest bin that allows one and shifts ``d`` tokens to a bin that has at
    least ``d`` room and ends up fuller than the first one was: an item moves, two items trade
    places, or two of one bin trade with one of the other. Of all such steps of the bin the one with
    the largest gain is made. A bin left without items is gone. The search ends when no step is
    left, or when the room elsewhere cannot take the emptiest bin (no bin can be saved then).
    """

    def __init__(self, bins: list[list[int]], size: int):
        """``bins``: the item sizes of each bin."""
        self.size = size
        self.bins = [list(b) for b in bins]
        self.fill = np.array([sum(b) for b in bins], np.int64)
        self.known: dict[int, tuple] = {}

    def run(self) -> list[tuple[int, int, list[int], list[int]]]:
        """The steps made: (from bin, to bin, sizes moved there, sizes moved back)."""
        made, stuck, since = [], set(), 0
        while True:
            live = np.flatnonzero((self.fill > 0) & (self.fill < self.size))
            live = live[np.argsort(self.fill[live], kind="stable")]
            if len(live) < 2 or (self.size - self.fill[live[1:]]).sum() < self.fill[live[0]]:
                return made
            goals = self._goals(live)
            for a in live.tolist():
                if a not in stuck:
                    step = self._best(a, goals)
                    if step:
                        break
                    stuck.add(a)
            else:
                if since == len(made):      # nothing has changed since all bins were tried
                    return made
                stuck, since = set(), len(made)
                continue
            b, there, back = step
            for s in there:
                self.bins[a].remove(s)
                self.bins[b].append(s)
            for s in back:
                self.bins[b].remove(s)
                self.bins[a].append(s)
            d = sum(there) - sum(back)
            self.fill[a] -= d
            self.fill[b] += d
            for c in (a, b):
                self.known.pop(c, None)
            made.append((a, b, there, back))

    def _parts(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What may leave a bin, smaller item first: (0, x) for its sizes, (x, y) for its pairs; equal ones once."""
        if b not in self.known:
            sizes, many = np.unique(np.array(self.bins[b], np.int64), return_counts=True)
            i, j = np.triu_indices(len(sizes))
            apart = (i != j) | (many[i] > 1)
            self.known[b] = (np.column_stack((np.zeros_like(sizes), sizes)), np.column_stack((sizes[i], sizes[j]))[apart])
        return self.known[b]

    def _goals(self, live: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bins, what leaves them) for nothing, single items and pairs."""
        parts = [self._parts(b) for b in live.tolist()]
        ones, twos = ([p[k] for p in parts] for k in (0, 1))
        return [(live, np.zeros((len(live), 2), np.int64)),
                *((np.repeat(live, [len(p) for p in ps]), np.concatenate(ps)) for ps in (ones, twos))]

    def _best(self, a: int, goals):
        """(to bin, sizes there, sizes back) of the step with the largest gain, or None."""
        one, two = self._parts(a)
        best, most, fill = None, 0, self.fill
        for mine, kinds in ((one, (0, 1, 2)), (two, (1,))):
            mine = mine[mine.sum(1) <= self.size]
            for k in kinds:
                where, back = goals[k]
                if not len(where):
                    continue
                near = fill[where] - np.where(where == a, 1 << 40, fill[a])     # never to itself
                room, less = self.size - fill[where], back.sum(1)
                for at in range(0, len(mine), 64):
                    d = mine[at: at + 64].sum(1)[:, None] - less
                    gain = np.where((d > 0) & (d <= room), d * (near + d), 0)
                    i, j = divmod(int(gain.argmax()), len(where))
                    if gain[i, j] > most:
                        most = int(gain[i, j])
                        best = (int(where[j]), [s for s in mine[at + i].tolist() if s], [s for s in back[j].tolist() if s])
        return best


class Packer:
    """Pieces in, sequences out: whole ones at once, the others by pools of bounded size."""

    def __init__(self, size: int = SIZE, pool: int = POOL, most_open: int = OPEN_BINS):
        self.size, self.pool, self.most_open = size, pool, most_open
        self.new: list[tuple] = []          # pieces: (ids, ...)
        self.waiting = 0
        self.open: list[list[tuple]] = []   # underfull bins

    def add(self, ids: np.ndarray, *about):
        """Yields finished sequences: lists of (ids, piece number, start, *about)."""
        n, size = len(ids), self.size
        first = n % size or min(n, size)
        for k, at in enumerate([0, *range(first, n, size)]):
            piece = (ids[at: at + (size if k else first)], k, at, *about)
            if len(piece[0]) == size:
                yield [piece]
            else:
                self.new.append(piece)
                self.waiting += len(piece[0])
        if self.waiting >= self.pool:
            yield from self.close(last=False)

    def close(self, last: bool = True):
        """Pack what waits into the open bins and new ones, exchange, and give out what is done."""
        bins = self.open
        fills = [sum(len(p[0]) for p in b) for b in bins]
        sizes = np.array([len(p[0]) for p in self.new], np.int64)
        placed = best_fit(sizes, self.size, fills)
        bins.extend([] for _ in range(len(fills) - len(bins)))
        for piece, b in zip(self.new, placed.tolist()):
            bins[b].append(piece)
        self.new, self.waiting = [], 0
        full = [b for b in bins if sum(len(p[0]) for p in b) == self.size]
        bins = [b for b in bins if sum(len(p[0]) for p in b) < self.size]
        if last or len(bins) > self.most_open:      # bins are closed that could be fuller
            self._exchange(bins)
        left = sorted((b for b in bins if b), key=lambda b: sum(len(p[0]) for p in b))
        keep = 0 if last else min(self.most_open, len(left))
        self.open = left[:keep]
        yield from left[keep:]
        yield from full

    def _exchange(self, bins: list[list[tuple]]):
        for a, b, there, back in Exchange([[len(p[0]) for p in b] for b in bins], self.size).run():
            for source, goal, moved in ((a, b, there), (b, a, back)):
                for s in moved:
                    i = next(i for i, p in enumerate(bins[source]) if len(p[0]) == s)
                    bins[goal].append(bins[source].pop(i))


def best_fit_packed(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID,
                    pool: int = POOL, most_open: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """Sequences of at most ``size`` ids over all documents, in as few as the search finds: one row per piece.

    A document is its token ids and the end id. Only one longer than ``size`` is cut, from its end into
    pieces of ``size``; its first piece may be shorter. Null text counts as empty, so every row has at least
    one id; repeated rows are packed each; an empty table gives no piece. There is no shuffle: every
    task packs the rows it reads, ``pool`` tokens at a time, and keeps up to ``most_open`` underfull bins
    for the next ones; so at most one sequence of each task is needed less by another dealing. Sequence
    ids are the task's number and a running number, the same in a repeated task.
    """

    names = [x.split()[0] for x in RESULT.split(", ")]

    def pack(batches):
        encode, packer = ByteBpe(tokenizer), Packer(size, pool, most_open)
        number = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def table():
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in cols[-1]]))).astype(np.int32)
                flat = np.concatenate(cols[-1]).astype(np.int32) if rows else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(flat)))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names[:len(arrays)])

        def emit(sequences):
            nonlocal number
            for sequence in sequences:
                at = 0
                for ids, k, start, doc, n in sequence:
                    rows.append((doc, k, start, len(ids), zlib.crc32(ids.tobytes()), number, at, n, ids))
                    at += len(ids)
                number += 1
                if len(rows) >= 4000:
                    yield table()

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                yield from emit(packer.add(ids, doc, len(ids)))
        yield from emit(packer.close())
        yield table()

    return text_rows(docs).mapInArrow(pack, RESULT if with_ids else RESULT.rpartition(", ")[0])
