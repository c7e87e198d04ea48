"""Product codes of vectors: each part of a vector is replaced by its nearest entry of a codebook, fitted by Lloyd's rounds.

Rounds follow Elkan: each vector carries, for each of its parts, an upper bound of the distance to its entry
and a lower bound of the distance to every entry. When entries move, the bounds are shifted by how far; an entry whose
lower bound lies strictly above the upper bound is not looked at. What is left is compared in whole numbers, so bounds only
ever save work. Bounds are rounded outwards to 16 bits. The bounds are a table in the shared folder, written once a round.

The codebooks (parts x entries, sizes that are parameters) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checked_broadcast, drop, written

#: Whole numbers to which sums and squares of doubles are exact.
EXACT = 1 << 53
#: Sums leave a task in limbs of so many bits, as longs.
LIMB = 62
#: Errors beyond it are given as it.
LARGEST = (1 << 63) - 1
#: A component is floor(SCALE * x).
SCALE = 256

_STATE = "codes binary, upper binary, lower binary"


def clean_vectors(rows: DataFrame, vector_col: str) -> Column:
    """Whether a row has a vector of at least one component, all of them finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def common_length(vectors: DataFrame, vector_col: str, multiple: int = 1) -> int:
    """The most frequent length, of those that `multiple` divides; the smallest of equally frequent ones, 0 without rows."""
    sizes = vectors.groupBy(F.size(vector_col).alias("size")).count().where(F.col("size") % multiple == 0)
    first = sizes.orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of lists of `size` numbers as rows of doubles."""
    values = column.values if not column.offset and len(column.values) == len(column) * size else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), size)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as doubles where these hold it exactly, which is always but for components near the largest double."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    if np.isfinite(out).all():
        return out
    return np.array([int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape) if out.size else out


def _small(x: np.ndarray) -> bool:
    """Whether squared distances of such parts are exact in doubles."""
    return x.dtype != object and (not x.size or float(np.abs(x).max()) < (EXACT / (4 * x.shape[-1])) ** 0.5)


def _as_ints(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly: doubles where these are exact, Python's whole numbers otherwise."""
    if not (_small(x) and _small(y)):
        x, y = _as_ints(x), _as_ints(y)
    d = x - y
    return (d * d).sum(axis=-1)


def root(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of whole numbers as doubles, rounded outwards."""
    if d.dtype == object:
        d = np.array([float(v) if v < 1 << 1000 else np.inf if up else 2.0**1000 for v in d.ravel().tolist()]).reshape(d.shape)
    toward = np.inf if up else 0
    return np.nextafter(np.nextafter(np.sqrt(d), toward), toward)


def _narrow(v: np.ndarray, up: bool) -> np.ndarray:
    """Bounds in 16 bits, rounded outwards."""
    with np.errstate(over="ignore"):
        h = v.astype(np.float16)
    if up:
        return np.where(h.astype(np.float64) < v, np.nextafter(h, np.float16(np.inf)), h)
    h = np.minimum(h, np.finfo(np.float16).max)
    return np.where(h.astype(np.float64) > v, np.nextafter(h, np.float16(0)), h)


class Codebook:
    """The entries of one part: n x width whole numbers, and what assigning needs of their distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries if _small(entries) else _as_ints(entries)
        n = len(entries)
        apart = squared(self.entries[:, None, :], self.entries[None, :, :])
        self.half = root(apart, up=False) / 2  # half of the distance of two entries, not above it
        clear = self.half.copy()
        clear[np.arange(n), np.arange(n)] = np.inf
        self.clear = clear.min(axis=1) if n else clear

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """Nearest entries of rows x (lower index of equal ones): codes, squared distances, upper and lower bounds. Bounds: None at first."""
        n, k = len(x), len(self.entries)
        if code is None:
            d = squared(x[:, None, :], self.entries[None, :, :])
            code = d.argmin(axis=1)
            best = d[np.arange(n), code]
            return code, best, root(best, up=True), root(d, up=False)
        best = squared(x, self.entries[code])
        upper = np.minimum(upper, root(best, up=True))
        # strict: an entry at the same distance is never cut off
        moved = np.flatnonzero(upper >= self.clear[code])
        if len(moved):
            u = upper[moved, None]
            near = (lower[moved] <= u) & (self.half[code[moved]] <= u)
            near[np.arange(len(moved)), code[moved]] = True
            at, entry = np.nonzero(near)
            row = moved[at]
            d = squared(x[row], self.entries[entry])
            lower[row, entry] = root(d, up=False)
            order = np.lexsort((entry, d.astype(np.float64), at)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (at[i], d[i], entry[i])), np.int64)
            first = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
            code[moved], best[moved] = entry[first], d[first]
            upper[moved] = root(best[moved], up=True)
        return code, best, upper, lower


def _bounds(batch: pa.RecordBatch, first: int, parts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    read = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)
    return read(first, np.uint16).reshape(n, parts).astype(np.int64), read(first + 1, np.float16).reshape(n, parts).astype(np.float64), read(first + 2, np.float16).reshape(n, parts, k)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    n, width = len(rows), rows[0].nbytes if len(rows) else 0
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _assigned(batch: pa.RecordBatch, books: list[Codebook], shifts: list[np.ndarray] | None, size: int):
    """Codes, squared distances (n x parts), upper and lower bounds of a batch (vec_id, label, embedding, then the bounds)."""
    x, parts, k = whole(matrix(batch.column(2), size)), len(books), len(books[0].entries)
    width, n = size // parts, batch.num_rows
    codes, uppers = np.zeros((n, parts), np.int64), np.zeros((n, parts))
    lowers = np.zeros((n, parts, k), np.float16)
    errors: list[np.ndarray] = []
    if shifts is not None:
        codes, uppers, kept = _bounds(batch, 3, parts, k)
    for p, book in enumerate(books):
        own = x[:, p * width : (p + 1) * width]
        if shifts is None:
            code, best, upper, lower = book.assign(own, None, None, None)
        else:
            with np.errstate(over="ignore"):
                upper = np.nextafter(uppers[:, p] + shifts[p][codes[:, p]], np.inf)
                lower = np.maximum(np.nextafter(kept[:, p].astype(np.float64) - shifts[p][None, :], -np.inf), 0)
            code, best, upper, lower = book.assign(own, codes[:, p].copy(), upper, lower)
        codes[:, p], uppers[:, p], lowers[:, p] = code, upper, _narrow(lower, up=False)
        errors.append(best)
    return x, codes, errors, uppers, lowers


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**LIMB; the last digit has its sign."""
    place = 0
    while not -(1 << LIMB) <= total < 1 << LIMB:
        yield place, total & ((1 << LIMB) - 1)
        total >>= LIMB
        place += 1
    yield place, total


class _Sums:
    """Sums of the parts assigned to each entry, exact."""

    def __init__(self, parts: int, k: int, width: int):
        self.count = np.zeros((parts, k), np.int64)
        self.totals = np.zeros((parts, k, width), object)

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        parts, k, width = self.totals.shape
        exact = x.dtype != object and (not x.size or float(np.abs(x).max()) * len(x) < EXACT)
        for p in range(parts):
            own = x[:, p * width : (p + 1) * width]
            self.count[p] += np.bincount(codes[:, p], minlength=k)
            if exact:
                more = np.stack([np.bincount(codes[:, p], weights=own[:, c], minlength=k) for c in range(width)], axis=1).astype(np.int64)
                self.totals[p] += more.astype(object)
            else:
                for code, part in zip(codes[:, p].tolist(), _as_ints(own), strict=True):
                    self.totals[p, code] += part

    def rows(self) -> pa.RecordBatch:
        """part, entry, component (-1 for the count), limb, value of the entries that have parts."""
        out = []
        for p, e in zip(*np.nonzero(self.count), strict=True):
            out.append((p, e, -1, 0, int(self.count[p, e])))
            for c, total in enumerate(self.totals[p, e].tolist()):
                out += [(p, e, c, limb, value) for limb, value in _limbs(int(total))]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "component", "limb", "value"])


def _entry_sums(state: DataFrame, parts: int, k: int, size: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and componentwise sum of the parts assigned to it. Summed in each task, then by Spark."""

    def run(batches):
        sums = _Sums(parts, k, size // parts)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, parts).astype(np.int64)
            sums.add(whole(matrix(batch.column(0), size)), codes)
        yield sums.rows()

    each = state.select("embedding", "codes").mapInArrow(run, "part int, entry int, component int, limb int, value long")
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for row in each.groupBy("part", "entry", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        count, totals = found.setdefault((row["part"], row["entry"]), (0, [0] * (size // parts)))
        if row["component"] < 0:
            found[row["part"], row["entry"]] = (int(row["value"]), totals)
        else:
            totals[row["component"]] += int(row["value"]) << (LIMB * row["limb"])
    return found


def _moved(books: list[Codebook], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> tuple[list[Codebook], list[np.ndarray]]:
    """Entries at the mean of their parts, rounded down; unused ones stay. Also how far each has moved, not less."""
    new, shifts = [], []
    for p, book in enumerate(books):
        entries = _as_ints(book.entries).copy()
        for e in range(len(entries)):
            if (p, e) in sums:
                count, totals = sums[p, e]
                entries[e] = [t // count for t in totals]
        moved = Codebook(_plain(entries))
        new.append(moved)
        shifts.append(root(squared(moved.entries, book.entries), up=True))
    return new, shifts


def _plain(entries: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles if these hold them exactly."""
    if all(abs(v) < EXACT for v in entries.ravel().tolist()):
        return entries.astype(np.float64)
    return entries


def fit(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> tuple[list[Codebook], list[np.ndarray] | None, DataFrame]:
    """Codebooks after `rounds` rounds, how far the last round moved their entries, and the table with each vector's bounds before that.

    vectors: a table vec_id, label, embedding that can be read again.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = whole(np.array([row["embedding"] for row in first], np.float64))
    width = size // parts
    books = [Codebook(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    state, shifts = vectors, None
    for _ in range(rounds):
        before, state = state, written(_state(state, books, shifts, size), "bounds")
        if before is not vectors:
            _discard(before)
        books, shifts = _moved(books, _entry_sums(state, parts, len(first), size))
    return books, shifts, state


def _discard(table: DataFrame) -> None:
    """Delete a round's table."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()[:1]}:
        drop(table.sparkSession, path)


def _state(state: DataFrame, books: list[Codebook], shifts: list[np.ndarray] | None, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            _, codes, _, uppers, lowers = _assigned(batch, books, shifts, size)
            columns = [*batch.columns[:3], _binary(codes.astype(np.uint16)), _binary(_narrow(uppers, up=True)), _binary(lowers)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "embedding", "codes", "upper", "lower"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields[:3]]
    return state.mapInArrow(run, ", ".join(kinds) + ", " + _STATE)


def codebooks_text(books: list[Codebook]) -> str:
    """All components of all entries by part, entry and position, joined by commas."""
    return ",".join(str(v) for book in books for v in _as_ints(book.entries).ravel().tolist())


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: product codes of all vectors.

    A component x counts as floor(256 * x). The codebook of each of `parts` equal parts starts as that part of the `entries` vectors with
    the smallest ids. Each of `rounds` rounds assigns every part to its nearest entry and moves each entry to the mean of its parts,
    rounded down; then parts are assigned once more. code: the entries' indexes, two hex digits for each part. error: squared distances
    summed over parts. label_error: errors summed over equal labels, null labels together.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, as are those whose length isn't the most
    frequent one that `parts` divides. Repeated rows count each time; among the starts the smaller of vectors with equal ids comes first, null ids last. With fewer vectors than `entries` there are as many entries as vectors.
    Components of any finite size are exact; errors beyond a long are given as 2**63 - 1. Other columns are ignored; without vectors the result is empty.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("from 1 to 256 entries, and at least one part")
    spark = rows.sparkSession
    bound_batches(spark)
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    vectors = vectors.where(clean_vectors(vectors, "embedding"))
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    size = common_length(vectors, "embedding", parts)
    if not size:
        return spark.createDataFrame([], out)
    vectors = vectors.where(F.size("embedding") == size)
    books, shifts, state = fit(vectors, size, parts, entries, rounds)

    def run(batches):
        for batch in batches:
            _, codes, errors, _, _ = _assigned(batch, books, shifts, size)
            raw = codes.astype(np.uint8).tobytes().hex()
            total = [min(LARGEST, sum(int(e) for e in each)) for each in zip(*(e.tolist() for e in errors), strict=True)]
            code = [raw[2 * parts * i : 2 * parts * (i + 1)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields[:2]]
    coded = written(state.mapInArrow(run, ", ".join(kinds) + ", code string, error long"), "codes")
    if state is not vectors:
        _discard(state)
    most = F.lit(LARGEST).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.join(checked_broadcast(written(sums, "label-errors")), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
