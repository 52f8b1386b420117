"""Hierarchical packing: context-size tiers, long windows topped up from shorter tiers, balanced step groups.

Each task packs the documents it reads, so nothing is shuffled: documents leave full windows of the longest tier, the
rest of each goes to the tier that fits it, and tiers are packed from the longest down by best fit. A window's last
gap is closed by cutting a shorter document, so that windows of every tier are full. Windows of a tier gather until
they make up a step group, and all step groups have equally many tokens; at the end of a task the shorter tiers' rest
is packed again into windows of the longest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import default_path, encode

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that a task gathers before it packs.
POOL_TOKENS = 1 << 21
#: Tokens of a step group: the windows of one tier that make up a step.
STEP_TOKENS = 8 * WINDOW

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class Packer:
    """Packs one task's documents; `rows` gathers the pieces of finished windows.

    A piece is (length, document's number, start). Of a document only the tail that waits is held: `docs` has its id,
    its number of tokens, where the tail begins, and the tail.
    """

    def __init__(self, partition: int):
        self.rows: list[tuple] = []
        self.docs: dict[int, tuple[int | None, int, int, np.ndarray]] = {}
        #: Per tier, pieces in order of length.
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}
        #: Per tier, the windows of the step group that is being filled: rows without sequence and group, and pieces.
        self.open: dict[int, list[tuple[list[tuple], list[tuple[int, int, int]]]]] = {t: [] for t in TIERS}
        self.seen = self.held = 0
        self.sequence = self.first = partition << 33
        self.steps = 0

    def add(self, doc_id: int | None, ids: list[int]) -> None:
        whole = np.array([*ids, END_ID], dtype="<u4")
        number, full = self.seen, len(whole) // WINDOW * WINDOW
        self.seen += 1
        for start in range(0, full, WINDOW):
            row = doc_id, start, WINDOW, zlib.crc32(whole[start : start + WINDOW].tobytes()), len(whole), 0
            self._gather([row], [], WINDOW)
        if full < len(whole):
            self.docs[number] = doc_id, len(whole), full, whole[full:].copy()
            self._route((len(whole) - full, number, full))
            self.held += len(whole) - full
        if self.held >= POOL_TOKENS:
            self.pack()

    def _route(self, piece: tuple[int, int, int]) -> None:
        insort(self.pools[min(t for t in TIERS if t >= piece[0])], piece)

    def _take(self, room: int, tiers: tuple[int, ...]) -> tuple[int, int, int] | None:
        """The longest piece of these tiers that fits."""
        for tier in tiers:
            at = bisect_right(self.pools[tier], (room, 1 << 62, 0))
            if at:
                return self.pools[tier].pop(at - 1)
        return None

    def _cut(self, room: int, tiers: tuple[int, ...]) -> tuple[int, int, int] | None:
        """The first `room` tokens of the shortest longer piece; its rest is routed again."""
        for tier in reversed(tiers):
            at = bisect_right(self.pools[tier], (room, 1 << 62, 0))
            if at < len(self.pools[tier]):
                length, number, start = self.pools[tier].pop(at)
                self._route((length - room, number, start + room))
                return room, number, start
        return None

    def _fill(self, size: int, window: list[tuple[int, int, int]]) -> int:
        """Tops a window up from the tiers that are no longer than it; returns the room that is left."""
        own = tuple(t for t in TIERS if t <= size)
        room = size - sum(piece[0] for piece in window)
        while room and (piece := self._take(room, own)):
            window.append(piece)
            room -= piece[0]
        if room and (piece := self._cut(room, own)):
            window.append(piece)
            room = 0
        return room

    def _rows(self, window: list[tuple[int, int, int]]) -> list[tuple]:
        out, offset = [], 0
        for length, number, start in window:
            doc_id, total, base, ids = self.docs[number]
            out.append((doc_id, start, length, zlib.crc32(ids[start - base : start - base + length].tobytes()), total, offset))
            offset += length
        return out

    def _gather(self, rows: list[tuple], window: list[tuple[int, int, int]], tier: int) -> None:
        """Adds a full window to its tier's step group, and writes the group once it has STEP_TOKENS tokens."""
        self.open[tier].append((rows, window))
        if len(self.open[tier]) * tier == STEP_TOKENS:
            for known, _ in self.open[tier]:
                self._write(known, tier, self.first + self.steps)
            self.open[tier] = []
            self.steps += 1

    def _write(self, rows: list[tuple], tier: int | None, group: int | None) -> None:
        self.rows += [(*row[:5], self.sequence, row[5], tier, group) for row in rows]
        self.sequence += 1

    def pack(self) -> None:
        """Packs every tier from the longest down; what can't fill a window waits."""
        wait: list[tuple[int, int, int]] = []
        for tier in TIERS:
            while self.pools[tier]:
                window = [self.pools[tier].pop()]
                if self._fill(tier, window):
                    wait += window
                    break
                self._gather(self._rows(window), window, tier)
            while self.pools[tier] and tier == TIERS[-1]:
                wait.append(self.pools[tier].pop())
        for piece in wait:
            self._route(piece)
        self._forget()

    def _forget(self) -> None:
        waiting = [piece for pool in self.pools.values() for piece in pool]
        kept = {piece[1] for piece in waiting} | {piece[1] for windows in self.open.values() for _, window in windows for piece in window}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        self.held = sum(piece[0] for piece in waiting)

    def finish(self) -> None:
        """Packs what is left into windows of the longest tier, those of begun step groups of shorter tiers included.

        Windows that make up no whole step, fewer than one step's tokens, have no step group. The last tokens become
        windows of the tiers' sizes if these hold them exactly, else one padded window without a tier.
        """
        self.pack()
        for tier in TIERS[1:]:
            for _, window in self.open[tier]:
                for piece in window:
                    self._route(piece)
            self.open[tier] = []
        self._forget()
        while self.held >= WINDOW:
            window: list[tuple[int, int, int]] = []
            self._fill(WINDOW, window)
            self._gather(self._rows(window), window, WINDOW)
            self.held -= WINDOW
        for rows, _ in self.open[WINDOW]:
            self._write(rows, WINDOW, None)
        exact = self.held % TIERS[-1] == 0
        for size in TIERS if exact else (WINDOW,):
            while self.held and (self.held >= size or not exact):
                window = []
                self._fill_any(min(size, self.held), window)
                self._write(self._rows(window), size if exact else None, None)
                self.held -= min(size, self.held)

    def _fill_any(self, size: int, window: list[tuple[int, int, int]]) -> None:
        while size:
            piece = self._take(size, TIERS) or self._cut(size, TIERS)
            window.append(piece)
            size -= piece[0]

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.assign(doc_id=pd.array(list(map(itemgetter(0), rows)), "Int64")).assign(step_group=pd.array(list(map(itemgetter(8), rows)), "Int64")).astype({"tier": "Int32"})


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """documents -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is its end token alone. Every row of the input is a document of its own, repeated rows and
    null ids included; other columns, also of clashing names, are ignored; an empty table gives no pieces. tier is the
    length of a full window; a task's last window may be padded and then has none. All windows of a step_group have one
    tier and STEP_TOKENS tokens together; the last windows of a task, fewer than that, have none. A task holds at most
    about POOL_TOKENS ids of tails that wait, the begun step groups, and one document. Sequence and step group numbers
    begin at the task's partition number times 2^33, so that a task that runs again gives the same ones for the same rows.
    """
    path = path or default_path()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(None if doc_id is None else int(doc_id), encode(path, text or ""))
                if len(packer.rows) >= 50_000:
                    yield packer.taken()
        packer.finish()
        yield packer.taken()

    # As text, ids pass through pandas unchanged also where some are null.
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(packed, SCHEMA)
