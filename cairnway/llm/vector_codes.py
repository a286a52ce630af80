"""Short codes of vectors from integer codebooks, with products that are exact."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.session import cut

#: A component x is the integer floor(SCALE * x).
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors that a task multiplies at a time.
BLOCK = 8192


def limb_bits(n: int) -> int:
    """Bits of a limb so that n products of two limbs add up to less than 2**53."""
    return (52 - max(0, math.ceil(math.log2(max(n, 1))))) // 2


def largest_component(n: int) -> int:
    """Components up to this keep every squared distance of n of them, and all of its terms, below 2**63."""
    return min(math.isqrt(((1 << 63) - 1) // max(n, 1)) // 2 - 1, (1 << 31) - 1)


def limbs(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """values = low + 2**bits * high, with low in 0 .. 2**bits - 1 and the sign in high."""
    high = values >> bits
    return (values - (high << bits)).astype(np.float64), high.astype(np.float64)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 32-bit integers held in int64, by float64 matrix products of limbs.

    Both limbs of all rows meet both limbs of all columns in one product. Each of its entries
    is below 2**53, so it is an exact integer; the four blocks are put together in int64.
    """
    bits = limb_bits(a.shape[1])
    low, high = limbs(b, bits)
    done = (np.concatenate(limbs(a, bits)) @ np.concatenate([low, high], 1)).astype(np.int64)
    r, k = a.shape[0], b.shape[1]
    crossed = done[:r, k:] + done[r:, :k]
    return done[:r, :k] + (crossed << bits) + (done[r:, k:] << (2 * bits))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance to it) for each row of x."""
    score = (entries * entries).sum(1)[None, :] - 2 * exact_product(x, entries.T)
    at = score.argmin(1)
    return at, (x * x).sum(1) + score[np.arange(len(x)), at]


def entry_sums(x: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    """(entries, n + 1): component sums and, last, the number of the rows of each entry."""
    bits = limb_bits(x.shape[1])
    low, high = limbs(x, bits)
    chosen = np.zeros((len(x), entries))
    chosen[np.arange(len(x)), at] = 1
    n = x.shape[1]
    done = (chosen.T @ np.concatenate([low, high, np.ones((len(x), 1))], 1)).astype(np.int64)
    return np.concatenate([done[:, :n] + (done[:, n : 2 * n] << bits), done[:, 2 * n :]], 1)


@dataclass
class Codebooks:
    """(parts, entries, n) integers; one array for all parts."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def refined(self, sums: np.ndarray) -> Codebooks:
        """Entries moved to the floor of the mean of their rows; unused ones stay."""
        after = self.entries.copy()
        for place in np.ndindex(after.shape):
            count = int(sums[(*place[:2], -1)])
            if count:
                after[place] = int(sums[place]) // count
        return Codebooks(after)


def _whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors without a null or non-finite component, as 32-bit integers."""
    for batch in batches:
        lists = batch.column("vector")
        sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
        ends = np.cumsum(np.maximum(sizes, 0))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        starts = ends - np.maximum(sizes, 0)
        kept = np.flatnonzero((sizes >= 0) & (bad[ends] == bad[starts]))
        packed = np.clip(np.nan_to_num(flat), -(2.0**31), 2.0**31 - 1).astype("<i4")
        rows = [packed[starts[i] : ends[i]].tobytes() for i in kept]
        peaks = [float(np.abs(flat[starts[i] : ends[i]]).max(initial=0)) for i in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), pa.array(sizes[kept].astype(np.int32)), pa.array(peaks, pa.float64()),
             *(batch.column(c).take(pa.array(kept)) for c in ("vec_id", "label"))],
            names=["q", "size", "peak", "vec_id", "label"],
        )


def integer_vectors(
    vectors: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, int]:
    """(vec_id, label, q) of the rows whose vector is whole, and the components of a vector.

    ``q`` are little-endian 32-bit integers, written once. Vectors of different lengths, a
    length that ``parts`` does not divide, and components past ``largest_component`` are
    errors: codes of such tables would not be comparable or not exact.
    """
    own = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    kind = own.schema["label"].dataType.simpleString()
    kept = cut(own.mapInArrow(_whole_vectors, f"q binary, size int, peak double, vec_id long, label {kind}"))
    facts = kept.agg(F.min("size").alias("least"), F.max("size").alias("size"), F.max("peak").alias("peak")).first()
    size = facts["size"] or 0
    if facts["least"] != facts["size"] or size % parts:
        raise ValueError(f"vectors of {facts['least']} to {size} components cannot be cut into {parts} equal parts")
    if (facts["peak"] or 0) > largest_component(size // parts):
        raise ValueError(f"components above {largest_component(size // parts) / SCALE} have no exact distances")
    return kept.select("vec_id", "label", "q"), size


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, n) of a binary column without nulls."""
    rows = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)
    return rows.reshape(len(column), parts, -1)


def fit(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the vectors of the smallest ids and follow their vectors' means.

    Every round is one pass: a task adds up its vectors by entry, Spark adds the tasks' sums,
    and entries x (size + parts) numbers come back, whatever the number of vectors.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    n = size // parts
    start = np.frombuffer(b"".join(bytes(r["q"]) for r in first), "<i4").astype(np.int64).reshape(len(first), parts, n)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        held = books.entries

        def run(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((*held.shape[:2], held.shape[2] + 1), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    x = _matrix(batch.column("q").slice(i, BLOCK), len(held))
                    for p, own in enumerate(held):
                        sums[p] += entry_sums(x[:, p], nearest(x[:, p], own)[0], len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["slot", "total"])

        done = vectors.select("q").mapInArrow(run, "slot long, total long").groupBy("slot").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        )
        sums = np.zeros(held.shape[0] * held.shape[1] * (held.shape[2] + 1), object)
        for r in done.collect():
            sums[r["slot"]] = int(r["total"])
        books = books.refined(sums.reshape(*held.shape[:2], held.shape[2] + 1))
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distance."""
    held = books.entries
    pairs = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                x = _matrix(batch.column("q"), len(held))
                code, error = np.zeros((len(x), len(held)), np.int64), np.zeros(len(x), np.int64)
                for p, own in enumerate(held):
                    code[:, p], far = nearest(x[:, p], own)
                    error += far
                text = pa.array(pairs[code].view(f"S{2 * len(held)}").ravel().astype(str).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Rows whose vector is null or holds null, NaN or infinite components are left out. Rows that
    repeat an id are coded each; among the first entries they stand in the order of the
    bytes of their integers, and a null id stands last. Equal distances go to the entry of the lower index.
    With fewer rows than entries there are as many entries as rows. ``label_error`` adds up the
    errors of equal labels, nulls together. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    kept, size = integer_vectors(vectors, parts, id_col, vector_col, label_col)
    books = fit(kept, size, parts, entries, rounds)
    coded = cut(encode(kept, books))
    summed = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(summed, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
