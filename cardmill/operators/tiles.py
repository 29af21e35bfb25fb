"""Pairs of tiles of records: what grows as the square of the data is computed in arrays and never shuffled or written.

Records are packed into tiles of some thousand, a row each, in the shared folder. Every two tiles meet by a cartesian
product of the files, which copies nothing to disk, and are compared in numpy, a stripe of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill import storage

#: Records of a tile, and of a stripe of the first tile that is compared at once.
TILE, STRIPE = 4096, 256
#: Columns of the strips in which the pairs of a key come, and pairs that are sent at once.
STRIP, BATCH = 128, 200_000


def packed(rows: DataFrame, scratch: storage.Scratch, name: str, tile: int = TILE, by: list[str] | None = None) -> DataFrame:
    """``k, data``: the rows, which have an ``id``, in tiles of about ``tile``, each a table in Arrow's stream format.

    With ``by``, tiles are ranges of ids, in their order, and the rows of each are sorted by these columns.
    """
    rows = scratch.cut(rows, f"{name}-rows")
    n = max(1, -(-rows.count() // tile))

    def stream(whole: pa.Table) -> pa.Array:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema) as out:
            out.write_table(whole)
        return pa.array([sink.getvalue().to_pybytes()], pa.binary())

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"k": table["k"].slice(0, 1), "data": stream(table.drop_columns(["k"]).combine_chunks())})

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [batch for batch in batches if batch.num_rows]:
            table = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([table["k"].chunk(0).slice(0, 1), stream(table.drop_columns(["k"]).combine_chunks())], names=["k", "data"])

    if by:
        ranges = rows.repartitionByRange(n, "id").sortWithinPartitions(*by).withColumn("k", F.spark_partition_id())
        return scratch.cut(ranges.mapInArrow(pack_part, "k int, data binary"), name)
    placed = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return scratch.cut(placed.groupBy("k").applyInArrow(pack, "k int, data binary"), name)


def meet(left: DataFrame, right: DataFrame | None, function: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``function(x, y, same)`` gives for every two tiles; without ``right``, for every unordered two of ``left`` and each with itself."""
    pairs = left.toDF("i", "x").crossJoin((left if right is None else right).toDF("j", "y"))
    if right is None:  # of i, j and j, i the one that spreads evenly over the products of files
        i, j = F.col("i"), F.col("j")
        pairs = pairs.filter((i == j) | ((i < j) == ((i + j) % 2 == 0)))
    one = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x, j, y = (batch.column(c) for c in range(4))
            for r in range(batch.num_rows):
                yield from function(_table(x[r]), _table(y[r]), one and i[r] == j[r])

    return pairs.mapInArrow(run, schema)


def _table(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, length of each); null lists are empty."""
    array = table[column].combine_chunks()
    sizes = np.diff(array.offsets.to_numpy()) if array.null_count == 0 else array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return array.flatten().to_numpy(zero_copy_only=False), np.asarray(sizes, np.int64)


def _key_bits(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """(a row of bits over the records of ``y`` for each shared key and an empty one, the rows of each record of ``x``); None if no key is shared."""
    (kx, nx), (ky, ny) = _lists(x, "keys"), _lists(y, "keys")
    shared = np.intersect1d(kx, ky)
    if not len(shared):
        return None

    def at(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
        held = shared[found] == keys
        return found[held], np.repeat(np.arange(len(sizes)), sizes)[held]

    key, row = at(ky, ny)
    bits = np.zeros((len(shared) + 1, -(-len(ny) // 8)), np.uint8)
    for b in range(8):  # a record has a key once, so no place comes twice
        mine = row & 7 == b
        bits[key[mine], row[mine] >> 3] |= np.uint8(1 << b)
    key, row = at(kx, nx)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    slots = np.full((int(place.max()) + 1 if len(place) else 0, len(nx)), len(shared))
    slots[place, row] = key
    return bits, slots


def _stripe(held: tuple[np.ndarray, np.ndarray] | None, at: int, to: int, width: int) -> np.ndarray:
    """Bits over the second tile's records that share a key, for the rows ``at`` to ``to`` of the first."""
    out = np.zeros((to - at, -(-width // 8)), np.uint8)
    if held is not None:
        for slot in held[1]:
            out |= held[0][slot[at:to]]
    return out


def _after(bits: np.ndarray, at: int) -> None:
    """Within one tile: leaves to each row only the rows behind it."""
    column, row = np.arange(bits.shape[1] * 8), np.arange(at, at + len(bits))
    bits &= np.packbits(column > row[:, None], axis=1, bitorder="little")


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the bits that are set."""
    flat = np.flatnonzero(np.unpackbits(bits, bitorder="little").view(bool))
    rows = np.repeat(np.arange(len(bits)), np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
    return rows, flat - rows * (bits.shape[1] * 8)


def _held(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys of a tile in order, the rows of each)."""
    keys, sizes = _lists(table, "keys")
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return found, np.split(np.repeat(np.arange(len(sizes)), sizes)[order], starts[1:])


def _rectangles(x: pa.Table, y: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, columns`` of the pairs that share a key, each once; within one tile the smaller id first.

    The pairs of a key are a rectangle without what earlier keys gave, the largest first. It comes in strips of a few
    columns: rows and columns then repeat in long runs, which a column store keeps in a small part of the space.
    """
    (kx, px), (ky, py) = _held(x), _held(y)
    _, ix, iy = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    if not len(ix):
        return
    given = np.zeros((x.num_rows, y.num_rows), bool)
    if same:
        place = np.argsort(pc.array_sort_indices(x["id"].combine_chunks()).to_numpy())
        given |= place[:, None] >= place
    for k in np.argsort([-len(px[i]) * len(py[j]) for i, j in zip(ix, iy, strict=True)], kind="stable"):
        rows, columns = px[ix[k]], py[iy[k]]
        for at in range(0, len(columns), STRIP):
            strip = columns[at : at + STRIP]
            cells = np.ix_(rows, strip)
            row, column = np.nonzero(~given[cells])
            given[cells] = True
            yield rows[row], strip[column]


def sharing(rows: DataFrame, scratch: storage.Scratch, tile: int = TILE) -> DataFrame:
    """``a, b``: every two records that share a number in ``keys``, each pair once; rows are ``id, keys``, a key once in a record.

    A tile is a range of ids, so that of two tiles one has all the smaller ids; its records lie by their keys, those of
    the first key together.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def pairs(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        if pc.min(x["id"]).as_py() > pc.min(y["id"]).as_py():
            x, y = y, x
        ix, iy, held, n = x["id"].combine_chunks(), y["id"].combine_chunks(), [], 0

        def batch() -> pa.RecordBatch:
            row, column = (pa.array(np.concatenate(c)) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([ix.take(row), iy.take(column)], names=["a", "b"])

        for found in _rectangles(x, y, same):
            held.append(found)
            n += len(found[0])
            if n >= BATCH:
                yield batch()
                held, n = [], 0
        if n:
            yield batch()

    return meet(packed(rows, scratch, "tiles", tile, by=["keys", "id"]), None, pairs, f"a {kind}, b {kind}")


def _units(table: pa.Table) -> dict[int, np.ndarray]:
    """By width, the vectors of the records in unit length; zeros where a record has none of that width, or none that has a length."""
    values, sizes = _lists(table, "vector")
    starts, out = np.cumsum(sizes) - sizes, {}
    for width in np.unique(sizes[sizes > 0]):
        x = np.zeros((len(sizes), width))
        own = np.flatnonzero(sizes == width)
        x[own] = values[starts[own][:, None] + np.arange(width)]
        length = np.linalg.norm(x, axis=1)
        ok = np.isfinite(length) & (length > 0)
        x[~ok] = 0
        x[ok] /= length[ok][:, None]
        if ok.any():
            out[int(width)] = x
    return out


def _dots(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Products of the given pairs of rows, in full precision."""
    parts = [np.einsum("ij,ij->i", x[rows[k : k + 20_000]], y[columns[k : k + 20_000]]) for k in range(0, len(rows), 20_000)]
    return np.concatenate(parts) if parts else np.zeros(0)


#: Rounding of a limit in full precision; error of a product of unit vectors in single precision, by width.
SLACK, SINGLE = 1e-12, 1.5e-7
#: Leading dimensions of the bound of a product, and the share of pairs above the limit from which it doesn't pay.
HEAD, OFTEN = 16, 0.02


def _headed(x: np.ndarray) -> np.ndarray:
    """The first dimensions and the length of the rest: the products of these are never below those of the whole."""
    return np.hstack([x[:, :HEAD], np.linalg.norm(x[:, HEAD:], axis=1)[:, None]]).astype(np.float32)


def _near(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``start, rows, columns, cosines`` of each stripe: the pairs of at least ``least`` (above 0), decided in full precision.

    Single precision, for high limits of a bound over the leading dimensions, only leaves out pairs that are below.
    """
    width = x.shape[1]
    slack = np.float32(least - 1e-6 - SINGLE * width)
    bound = least >= 0.9 and width >= 2 * HEAD
    sx, sy = (_headed(x), _headed(y)) if bound else (x.astype(np.float32), y.astype(np.float32))
    for at in range(0, len(x), STRIPE):
        flat = np.flatnonzero(sx[at : at + STRIPE] @ sy.T >= slack)
        if bound and len(flat) > OFTEN * STRIPE * len(y):
            bound, sx, sy = False, x.astype(np.float32), y.astype(np.float32)
            flat = np.flatnonzero(sx[at : at + STRIPE] @ sy.T >= slack)
        row, column = np.divmod(flat, len(y))
        found = _dots(x, y, at + row, column)
        ok = found >= least - SLACK
        yield at, row[ok], column[ok], found[ok]


def near(left: DataFrame, right: DataFrame | None, least: float, scratch: storage.Scratch, tile: int = TILE) -> DataFrame:
    """``a, b, cosine`` of ``id, vector``: the pairs of at least ``least``, exactly; with ``right``, of a row of either table."""
    kind = left.schema["id"].dataType.simpleString()

    def pairs(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ux, uy = _units(x), _units(y)
        for width in ux.keys() & uy.keys():
            for at, row, column, cosine in _near(ux[width], uy[width], least):
                if same:
                    row, column, cosine = (c[at + row < column] for c in (row, column, cosine))
                if len(row):
                    p, q = (side["id"].combine_chunks().take(pa.array(c)) for side, c in ((x, at + row), (y, column)))
                    yield pa.RecordBatch.from_arrays([p, q, pa.array(cosine)], names=["p", "q", "cosine"])

    sides = [packed(left, scratch, "left", tile), None if right is None else packed(right, scratch, "right", tile)]
    met = meet(*sides, pairs, f"p {kind}, q {kind}, cosine double")
    ends = ("p", "q") if right is not None else (F.least("p", "q"), F.greatest("p", "q"))
    return met.select(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(ends, "ab", strict=True)), "cosine")


def _near_bits(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, at: int, least: float) -> np.ndarray:
    """Bits over ``y`` of the vectors near a stripe of ``x``; what single precision can't decide is decided in full."""
    slack = 1e-6 + SINGLE * x.shape[1]
    s = sx[at : at + STRIPE] @ sy.T
    close = s >= np.float32(least - slack)
    flat = np.flatnonzero(close)
    open_ = flat[s.ravel()[flat] <= np.float32(least + slack)]
    row, column = np.divmod(open_, len(y))
    close.ravel()[open_] = _dots(x, y, at + row, column) >= least - SLACK
    return np.packbits(close, axis=1, bitorder="little")


def count_met(rows: DataFrame, least: float, scratch: storage.Scratch, tile: int = TILE) -> DataFrame:
    """``pairs``, one row: how many pairs of ``id, keys, vector`` share a key or have a cosine of at least ``least`` (above 0), without forming them."""

    def count(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        held, n, ux, uy = _key_bits(x, y), 0, _units(x), _units(y)
        both = [(ux[w], uy[w], ux[w].astype(np.float32), uy[w].astype(np.float32)) for w in ux.keys() & uy.keys()]
        for at in range(0, x.num_rows, STRIPE):
            bits = _stripe(held, at, min(at + STRIPE, x.num_rows), y.num_rows)
            for vectors in both:
                bits |= _near_bits(*vectors, at, least)
            if same:
                _after(bits, at)
            n += int(np.bitwise_count(bits).sum(dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    met = meet(packed(rows, scratch, "tiles", tile), None, count, "n bigint")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
