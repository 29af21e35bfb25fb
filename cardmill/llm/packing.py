"""Texts into containers of fixed token capacity: bounded-space online best-fit.

Each run of items is packed for one capacity with a fixed number of open bins, found through a bitset keyed by free
space: an item goes to the bin with the least room that still takes it; if none does and all bins are in use, the
fullest closes for a new one. When the run ends its open bins close as they are; nothing is packed twice. Runs are long,
so that what the last bins leave unused is a small share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.llm.encode import count_tokens


class OpenBins:
    """At most ``slots`` open bins of one capacity. A bin is a list of (key, start, size) items."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots, self.bits, self.open = capacity, slots, 0, 0
        self.by_room: dict[int, list[list]] = {}

    def _hold(self, room: int, items: list) -> None:
        self.by_room.setdefault(room, []).append(items)
        self.bits |= 1 << room
        self.open += 1

    def _take(self, room: int) -> list:
        bins = self.by_room[room]
        items = bins.pop()
        if not bins:
            del self.by_room[room]
            self.bits &= ~(1 << room)
        self.open -= 1
        return items

    def add(self, item: tuple, size: int) -> Iterator[list]:
        """Place an item of at most the capacity; gives the bins that close by it."""
        fitting = self.bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            items = self._take(room)
        else:
            if self.open >= self.slots:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            room, items = self.capacity, []
        items.append(item)
        if room > size:
            self._hold(room - size, items)
        else:
            yield items

    def rest(self) -> Iterator[list]:
        for bins in self.by_room.values():
            yield from bins


def pieces(size: int, capacity: int) -> Iterable[tuple[int, int]]:
    """(start, size) of what an item is placed as: whole, or cut at the capacity if it alone exceeds it."""
    return ((at, min(capacity, size - at)) for at in range(0, size, capacity))


_SCHEMA = "target_name string, container string, doc_id bigint, piece int, token_start bigint, tokens bigint"


def pack(sizes: DataFrame, targets: list[tuple[str, int]], slots: int = 64, tokens_per_run: int = 32_000_000) -> DataFrame:
    """Pack ``doc_id, n`` for each of ``targets`` (name, capacity): one row per placed piece.

    The items of a run follow from a hash of their id and the number of runs from the total size, so the result is the
    same on any cluster. Items of size 0 or null take no place. Rows with equal ids are different items.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    runs = max(1, -(-total // tokens_per_run))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    spread = sizes.filter("n > 0").withColumn("at", F.xxhash64("doc_id")).withColumn("run", F.pmod("at", F.lit(runs)).cast("int"))
    # one task per run and target
    spread = spread.select("run", F.explode(F.array(*[F.lit(k) for k in range(len(targets))]).cast("array<int>")).alias("target"), "at", "doc_id", "n")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bins, serial, out = None, None, 0, []

        def emit(closed: Iterable[list]) -> None:
            nonlocal serial
            for items in closed:
                container = f"{at[0]}-{serial}"
                out.extend((targets[at[1]][0], container, *item) for item in items)
                serial += 1

        for frame in frames:
            for run, target, doc, n in zip(frame["run"].tolist(), frame.target.tolist(), frame.doc_id.tolist(), frame.n.tolist(), strict=True):
                if (run, target) != at:
                    if bins:
                        emit(bins.rest())
                    at, serial, bins = (run, target), 0, OpenBins(targets[target][1], slots)
                for k, (start, size) in enumerate(pieces(n, bins.capacity)):
                    emit(bins.add((doc, k, start, size), size))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if bins:
            emit(bins.rest())
            yield pd.DataFrame(out, columns=names)

    tasks = min(runs * max(1, len(targets)), 100_000)
    ordered = spread.repartition(tasks, "run", "target").sortWithinPartitions("run", "target", "at", "doc_id", "n")
    return ordered.select("run", "target", "doc_id", "n").mapInPandas(packed, _SCHEMA)


def pack_texts(docs: DataFrame, targets: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", slots: int = 64) -> DataFrame:
    """Containers for the texts of ``docs`` at every capacity of ``targets`` (a small fixed table; capacities of 1 or more)."""
    scratch = storage.Scratch(docs.sparkSession, "packing")
    wanted = [(r.target_name, r.capacity_tokens) for r in targets.filter("capacity_tokens > 0").select("target_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "target_name").collect()]
    sizes = scratch.cut(count_tokens(docs, vocabulary=vocabulary), "sizes")
    return scratch.cut(pack(sizes, wanted, slots), "placed")


def fill(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens placed, the least possible number of containers and the share of room used."""
    per = placed.groupBy("target_name", "container").agg(F.sum("tokens").alias("t")).groupBy("target_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    per = per.join(F.broadcast(targets.select("target_name", "capacity_tokens").distinct()), "target_name")
    return per.select(
        "target_name", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill")
    )
