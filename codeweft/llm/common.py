"""Helpers shared by the training-data operators: shared storage, row keys and vectorised tokens."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions of this package travel to the executors by value, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"  # words of the whitespace contracts
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words of the lower-cased contracts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="codeweft"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = _own[0]
    return f"{found}/codeweft-{spark.sparkContext.applicationId}"


_made: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors.

    The files go when the session's JVM ends, or before: see discard() and intermediate()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _hadoop(spark, path)
    fs.deleteOnExit(target)
    for made in _made:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)
    fs.cancelDeleteOnExit(target)


def discard(df: DataFrame) -> None:
    """Deletes the files of what materialise() returned, once nothing reads them any more. Leaves others alone."""
    path = getattr(df, "_materialised", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def intermediate(spark: SparkSession):
    """What is materialised within goes at the end, but for what is passed to the function it gives."""
    made, kept = [], []
    _made.append(made)
    try:
        yield lambda df: kept.append(df._materialised) or df
    finally:
        _made.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)


_GAPS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
RAW_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # ALNUM before lower-casing: as many words


def alnum_words(text: Column) -> Column:
    """Words by ALNUM of the text with A-Z in lower case. One translate() and a plain split cost half of a regex."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + _GAPS, LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def free_name(df: DataFrame, name: str) -> str:
    """The name of an added column: followed by as many underscores as it takes to differ from df's own columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that names made on the way can't clash with them."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns]


def lowered(text: Column) -> Column:
    """A-Z only: lower() would change other letters too."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def row_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """Seeded order and key of a row; only rows equal in id and text share it."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.md5(text), F.lit("~"))))


def hash_share(h: Column) -> Column:
    """The first 32 bits of a hex hash as a number from 0 (included) to 1 (excluded)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Tells rows of equal key apart by a running number."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(key)))


# Vectorised words over the bytes of an Arrow string array ---------------------------------------------------------

CHUNK_BYTES = 2 << 20
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_spaced = np.ones(256, bool)
_spaced[[32, 9, 10, 11, 12, 13]] = False
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[97:123] = _alnum[128:] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, rows, bytes, offsets) of runs of rows that hold about `limit` bytes; a longer text comes alone.
    Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def fold(data: np.ndarray) -> np.ndarray:
    return _fold[data]


def spans(data: np.ndarray, offsets: np.ndarray, kind: str = "spaced") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the first word's number (one more entry than rows)."""
    inside = (_spaced if kind == "spaced" else _alnum)[data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_P, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which span_hash() gets the hash of any span."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Slots:
    """Numbers of known hashes, by tables of slots: those whose slot is taken go to the next, smaller table."""

    def __init__(self, hashes: np.ndarray, bits: int):
        """hashes: distinct."""
        self.hashes, self.bits, self.tables = hashes, bits, None

    def __getstate__(self):
        return {"hashes": self.hashes, "bits": self.bits, "tables": None}

    @staticmethod
    def _slot(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h if not level else mix(h + np.uint64(level))) >> np.uint64(64 - bits)).astype(np.int64)

    def _build(self) -> None:
        self.tables, rest, bits = [], np.arange(len(self.hashes)), self.bits
        while len(rest):
            slot = self._slot(self.hashes[rest], len(self.tables), bits)
            t = np.full(1 << bits, -1, np.int32)
            t[slot[::-1]] = rest[::-1]
            self.tables.append((bits, t))
            rest = rest[t[slot] != rest]
            bits = max(8, int(len(rest)).bit_length() + 3)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't known."""
        if self.tables is None:
            self._build()
        out = np.full(len(h), -1, np.int64)
        rows, part = None, h
        for level, (bits, t) in enumerate(self.tables):
            at = t[self._slot(part, level, bits)].astype(np.int64)
            hit = (at >= 0) & (self.hashes[np.maximum(at, 0)] == part)
            if rows is None:
                out[hit] = at[hit]
            else:
                out[rows[hit]] = at[hit]
            left = np.flatnonzero((at >= 0) & ~hit)
            rows = left if rows is None else rows[left]
            part = part[left]
        return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive word hashes within each row; a row of fewer words, but not none, has one of all its words.
    first: each row's first word, one more entry than rows. Returns the hashes and each row's first (one more)."""
    n = len(words)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h = h * _P + words[j : n - k + 1 + j]
            h = mix(h)
        else:
            h = np.zeros(0, np.uint64)
        per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        begin = np.r_[0, np.cumsum(per)]
        row = np.repeat(np.arange(len(per)), per)
        at = first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
        short = np.flatnonzero((count > 0) & (count < k))
        out = np.zeros(len(row), np.uint64)
        full = count[row] >= k
        out[full] = h[at[full]]
        for r in short:
            x = np.uint64(count[r])
            for w in words[first[r] : first[r + 1]]:
                x = x * _P + w
            out[begin[r]] = mix(np.array([x], np.uint64))[0]
    return out, begin


def labelled_sample(docs: DataFrame, label: str, per_class: int, seed: str) -> DataFrame:
    """At most per_class rows of each label, those of least seeded hash, with the label's number of rows (`of`).

    Counts by the hash's first 16 bits, 65536 a label at most, tell where each label's sample ends; only rows up to
    there are ranked: per_class and those of one value, however frequent the label and however many the map tasks."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))))
    ids = docs.select(F.col("doc_id").alias("id"), F.col(label).alias("y"), order.alias("o")).where("y is not null")
    ids = ids.withColumn("head", F.conv(F.substring("o", 1, 4), 16, 10).cast("int"))
    counts = ids.groupBy("y", "head").agg(F.count("*").alias("n"))
    label_rows = Window.partitionBy("y")
    counts = counts.withColumn("before", F.sum("n").over(label_rows.orderBy("head")) - F.col("n")).withColumn("of", F.sum("n").over(label_rows))
    ends = counts.where(F.col("before") < per_class).groupBy("y").agg(F.max("head").alias("end"), F.max("of").alias("of"))
    near = ids.join(F.broadcast(ends), "y").where(F.col("head") <= F.col("end"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("o", "id"))
    return near.withColumn("r", rank).where(F.col("r") <= per_class).select("id", "y", "of")


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's span first[i]:first[i + 1]."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def struct_array(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.StructArray:
    """A struct column from lists of numpy arrays, one for each chunk."""
    arrays = [pa.array(np.concatenate(v) if v else np.zeros(0), type=types[k], from_pandas=False) for k, v in columns.items()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))
