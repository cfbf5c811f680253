"""What the operators share: sized broadcasts, row keys, private names, and word hashing on Arrow text."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..storage import drop_table, materialize, shared_dir  # noqa: F401

#: A side is broadcast only if its written table has at most this many rows, and its columns at most this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes_of(field: StructField) -> Column:
    """About what a value takes in memory."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, ArrayType):
        width = 8 * (len(kind.elementType.fields) + 2) if isinstance(kind.elementType, StructType) else 8
        return 24 + width * F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0)).cast("long")
    if isinstance(kind, (StringType, BinaryType)):
        return 24 + F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    return F.lit(16 if not isinstance(kind, StructType) else 16 * len(kind.fields)).cast("long")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small in rows and bytes; else Spark joins it by shuffle. df should be a written table."""
    if df.limit(rows + 1).count() > rows:
        return df
    size = sum((_bytes_of(f) for f in df.schema.fields[1:]), _bytes_of(df.schema.fields[0]))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def may_hold(df: DataFrame, column: str, keys: DataFrame, key: str, most_bits: int = 26) -> DataFrame:
    """df with a boolean may_hold: true wherever the 64-bit hash in `column` is among those of keys, and at few rows else.

    Some 16 bits a key, 2 ** most_bits in all (8 MB), go to every task, so that most rows without a key need not be
    shuffled. With very many keys more rows are held to have one; none that has is missed."""
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.col(c), F.lit(1 << bits)) + 1
    marks = keys.select(place(key).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    marks = materialize(marks, "key-bits")
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    joined = df.join(F.broadcast(marks), F.bitmap_bucket_number(place(column)) == F.col("_bucket"), "left")
    return joined.select(*df.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("may_hold"))


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        out.append(own)
    return out


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row, so that rows which differ in any column can be told apart without doc_id."""
    of = lambda f: F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    mark = [F.col(f"`{c}`").isNull() for c in df.columns]  # else nulls leave no trace in the hash
    return F.xxhash64(*map(of, df.schema.fields), *mark)


def hash128(*cols: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of the columns, as columns h1 and h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), *cols, F.lit(7)).alias("h2")]


def give_back() -> None:
    """Return freed memory of this process to the system: Spark keeps a Python worker for the stages to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


# ---------------------------------------------------------------- words of Arrow text

SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_KEYS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ** 3 | 1) & (2**64 - 1) for i in range(64)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict = {}
#: Bytes of text hashed at once; a longer text is hashed on its own. A dozen numbers of 8 bytes are held for each.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if _POWERS.get("n", -1) < n:
        size = max(n, CHUNK) + 1
        for name, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a)
        _POWERS["n"] = size
    return _POWERS["p"][:n], _POWERS["i"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of (byte + 1) * P**k over i <= k < j."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=c[1:])
    return c


def text_chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK):
    """(first row, offsets from 0, bytes) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        i = j


def words(offs: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts: first byte, end byte, row, 64-bit hash (A-Z lower-cased)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    data = _LOWER[data] if lower else data
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    c = prefix_hashes(data)
    h = mix((c[ends] - c[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, h


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every run of k words within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        s += h[at + j] * _KEYS[j]
    return at, mix(s)


def shingle_sets(offs: np.ndarray, data: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    _, _, row, h = words(offs, data)
    at, s = windows(h, row, k)
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    cut = np.searchsorted(row[at], np.arange(n + 1))
    out = []
    for i in range(n):
        if count[i] >= k:
            a = np.sort(s[cut[i] : cut[i + 1]])
            out.append(a[np.concatenate(([True], a[1:] != a[:-1]))])
        elif count[i]:
            own = h[first[i] : first[i + 1]]
            out.append(mix(np.array([(own * _KEYS[: len(own)]).sum() + np.uint64(len(own))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> array of unsigned or signed 64-bit arrays."""
    offs = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))
