"""What the corpus operators share: shared-folder tables, word splitting, hashing."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship

#: What a Python worker holds at a time, of texts that can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
BROADCAST_KEYS = 200_000  # rows of one integer column, so 10 MB at most in a hash relation
WHITE = b" \t\n\x0b\x0c\r"


def prepared(spark: SparkSession) -> SparkSession:
    """For queries: ships the package and bounds Arrow batches for this session, where the user hasn't. Operators change no setting."""
    ship(spark)
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode alone (one machine), a folder of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


_paths: dict[str, SparkSession] = {}


def share(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends at files that outlive any executor.
    They go with dropped(), or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_drop_all)
    _paths[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by share() that no DataFrame in use reads any more."""
    for df in tables:
        if (path := getattr(df, "shared_path", None)) in _paths:
            _delete(_paths.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for path, spark in _paths.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone
            pass


def few(keys: DataFrame) -> bool:
    """Whether a table of one integer column is small enough to be sent to every executor."""
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def semi_joined(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in keys (one integer column of that name); keys are broadcast if their size, which is checked, allows."""
    return df.join(F.broadcast(keys) if few(keys) else keys, key, how)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, case aside."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def encode(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def plain_words(text) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these six characters."""
    return encode(text).split()


def lower_words(text) -> list[bytes]:
    """The same after lower-casing A-Z; bytes.lower() leaves all else alone."""
    return encode(text).lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; faster than a dictionary of the words, and without its memory."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPAN = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(SPAN, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = 0x5851F42D4C957F2D
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, from running sums of a polynomial over them: a few passes, whatever k is."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k >= SPAN:  # a few windows of very many
        return np.array([xxhash.xxh3_64_intdigest(h[i : i + k].tobytes()) for i in range(n)], np.uint64)
    out, step = np.empty(n, np.uint64), SPAN - k
    for a in range(0, n, step):
        part = h[a : a + step + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWER[: len(part)], out=sums[1:])
        out[a : a + step] = (sums[k:] - sums[:-k]) * _INVERSE[: len(part) - k + 1]
    return mixed(out)
