"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the texts of this subpackage: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]+"
#: Spark's setting that removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs in this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again; in ``files`` files at most.

    This cuts the lineage: a lost executor costs a read, never the jobs before. What the job shuffled is read by
    nothing after it and goes as soon as the table is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df if files is None else df.coalesce(files)).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(b) -> None:
    """Let go of a broadcast's value in this process; it is read from its local file when next asked for."""
    if b._path is not None:
        vars(b).pop("_value", None)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts, joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


# --- byte-level vector helpers: one array for all texts of a batch ---------------------------

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base modulo 2**64, and of its inverse."""
    if len(_POW["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[key] = np.cumprod(p, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray, other: bool = False) -> np.ndarray:
    """Running polynomial sums; ``range_hash`` gives from them the hash of any range. ``other``: with
    other values for the bytes, for a second hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = (mixed(_BYTE) if other else _BYTE)[data]
    out[1:] *= up[: len(data)]
    return np.cumsum(out, dtype=np.uint64, out=out)


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """``range_hash`` of all ranges of one width."""
    _, down = powers(len(sums))
    out = sums[width:] - sums[:-width]
    out *= down[: len(out)]
    return out


def range_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [a, b), equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return (sums[b] - sums[a]) * down[a]


def packed(x: np.ndarray) -> bytes:
    """Unsigned values by byte planes, so that empty upper bytes cost nothing."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_table(kind: str) -> np.ndarray:
    """Which bytes of UTF-8 belong to words: ``blank`` (all but white space) or ``alnum`` (0-9, A-Z, a-z and all above 7F)."""
    t = np.ones(256, bool)
    if kind == "blank":
        t[[0x20, *range(0x09, 0x0E)]] = False
        return t
    t[:0x80] = False
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        t[a:b] = True
    return t


class Words:
    """The words of a batch of texts as arrays; a text's words never run into the next text's.

    ``start``/``end``: byte ranges in ``data``; ``hash``: 64-bit hashes of the words with A-Z
    lower-cased; ``first``: for text i its words are ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts, kind: str, lower: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        joined = b" ".join(raw) + b" "
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        flags = np.zeros(len(self.data) + 2, np.int8)
        flags[1:-1] = word_table(kind)[self.data]
        edge = np.flatnonzero(flags[1:] != flags[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        sums = prefix_hash(self.data)
        self.hash = mixed(range_hash(sums, self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.bounds)


def batches(rows, text: str, limit: int = 1_000_000):
    """Cut Arrow-sized pandas frames so that a piece holds ``limit`` characters or one longer text."""
    for pdf in rows:
        if not len(pdf):
            continue
        sizes = pdf[text].map(lambda t: 0 if t is None else len(t)).to_numpy()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield pdf.iloc[at:i].reset_index(drop=True)
                at, total = i, 0
            total += int(n)
        yield pdf.iloc[at:].reset_index(drop=True)
