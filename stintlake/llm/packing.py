"""Harmonic packing of token sequences.

A length in (capacity / (k + 1), capacity / k] is of class k, and a bin of class k is filled with exactly k documents, class
by class and without looking at other classes, so every worker packs its own documents alone. What such a bin leaves
empty is topped up afterwards: it waits among at most ``waiting`` others until a document comes that fills it to within
``slack`` tokens. A document is cut only

- if it is longer than the capacity: into whole capacities, and the rest is packed as a document of its own class,
- if so many bins wait already: then it fills the largest hole that it can, and its rest is packed again,
- at a worker's end, where what still waits is packed anew: whole where it fits, the rest cut into full sequences, and
  the last tokens into sequences of powers of two, which need no padding.

A worker holds the ids of the documents that wait: at most ``waiting`` + (number of classes) sequences.

Defined results: a null text counts as empty, which still has its end id; rows with null or repeated ids are packed as
documents of their own; an empty table gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stintlake.llm.common import released, table
from stintlake.llm.word_bpe import word_bpe

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Sequence ids of a worker start at its number times this.
STRIDE = 1 << 40


class Packer:
    """One worker's bins. An item is (doc_id, ids, start, length): a document or what is left of one."""

    def __init__(self, capacity: int, worker: int, classes: int = 64, waiting: int = 128, slack: int = 12):
        self.capacity, self.next, self.out = capacity, worker * STRIDE, []
        self.classes, self.waiting, self.slack = min(classes, capacity), waiting, min(slack, capacity // 64)
        self.open = defaultdict(list)
        self.holes: list[tuple[int, int]] = []  # (tokens free, number of the bin), sorted
        self.bins: dict[int, list[tuple]] = {}
        self.made = 0

    def _close(self, items: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, length in items:
            part = ids if 4 * length == len(ids) else ids[4 * start : 4 * (start + length)]
            self.out.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, self.next, at))
            at += length
        self.next += 1

    def _wait(self, items: list[tuple], free: int) -> None:
        if free <= self.slack:
            self._close(items)
        else:
            self.made += 1
            self.bins[self.made] = items
            insort(self.holes, (free, self.made))

    def _fill(self, at: int, item: tuple) -> None:
        free, n = self.holes.pop(at)
        items = self.bins.pop(n)
        items.append(item)
        self._wait(items, free - item[3])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        start, left = 0, len(ids) // 4
        while left >= self.capacity:
            self._close([(doc_id, ids, start, self.capacity)])
            start, left = start + self.capacity, left - self.capacity
        while left:
            at = bisect_left(self.holes, (left,))
            fits = at < len(self.holes)
            if fits and self.holes[at][0] - left <= self.slack:
                return self._fill(at, (doc_id, ids, start, left))
            if len(self.holes) < self.waiting:
                k = min(self.capacity // left, self.classes)
                group = self.open[k]
                group.append((doc_id, ids, start, left))
                if len(group) == k:
                    del self.open[k]
                    self._wait(group, self.capacity - sum(i[3] for i in group))
                return
            if not at:  # all holes are larger
                return self._fill(0, (doc_id, ids, start, left))
            free = self.holes[at - 1][0]
            self._fill(at - 1, (doc_id, ids, start, free))
            start, left = start + free, left - free

    def finish(self) -> None:
        items = [i for group in [*self.bins.values(), *self.open.values()] for i in group]
        self.holes, self.bins, self.open = [], {}, defaultdict(list)
        for item in sorted(items, key=lambda i: -i[3]):  # whole ones, the longest first, into the tightest hole
            at = bisect_left(self.holes, (item[3],))
            if at < len(self.holes):
                self._fill(at, item)
            else:
                self._wait([item], self.capacity - item[3])
        rest = [i for n in sorted(self.bins) for i in self.bins[n]]
        total = sum(i[3] for i in rest)
        size, group = self.capacity, []
        while rest:
            while size > total:  # the last sequences: powers of two
                size = 1 << (total.bit_length() - 1)
            free = size - sum(i[3] for i in group)
            doc_id, ids, start, length = rest.pop()
            if length > free:
                rest.append((doc_id, ids, start + free, length - free))
            group.append((doc_id, ids, start, min(length, free)))
            if length >= free:
                self._close(group)
                group, total = [], total - size
        self.holes, self.bins = [], {}

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = zip(*rows) if rows else [()] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, SCHEMA.types)], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = word_bpe(tokenizer_path).encoder().encode, Packer(capacity, TaskContext.get().partitionId())
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, encode(text or "") + end)
                if len(packer.out) > 20_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
