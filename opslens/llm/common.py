"""Shared pieces of the training-data operators: table reading, staging in the
cluster's shared folder, the train/held-out split and vectorised text codes."""

from __future__ import annotations

import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: white space of the contracts: blank and the control characters 9 to 13
BLANKS = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without it; there a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    named = "file://" + tempfile.mkdtemp(prefix="opslens-llm-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh shared folder and read it back.

    Cuts the lineage: what follows rereads files instead of recomputing, also
    after a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the write's shuffle files go once the driver has collected its garbage; a
    # long operator would else keep those of all its steps until its end
    spark._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def unstage(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True where ``crc32(doc_id as text) mod 3`` is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


# ------------------------------------------------------------- text codes

def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """code point -> code point of its lower-case letter, 0 for any non-letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter codes of all texts in one array, 0 for other
    characters and one more 0 before each text and at the end; and the place
    at which each text starts."""
    parts, starts, at = [], np.zeros(len(texts) + 1, np.int64), 1
    zero = np.zeros(1, np.uint32)
    for i, text in enumerate(texts):
        starts[i] = at
        codes = code_points(nfc(text)) if text else zero[:0]
        parts += [zero, codes]
        at += len(codes) + 1
    starts[len(texts)] = at
    parts.append(zero)
    return lower_letters()[np.concatenate(parts)], starts


def slices(texts: list[str | None], most: int = 2_000_000) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` characters together, so that what a
    task holds at once is bounded by that or by one text."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            out.append((begin, i))
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def text_runs(texts: pa.Array, most: int = 300_000):
    """(place of the first, texts) of runs of about ``most`` bytes together, or
    of one text; the rest of the batch stays in Arrow."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, lo = np.cumsum(size), 0
    while lo < len(texts):
        begun = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begun + most, "right")))
        yield lo, texts.slice(lo, hi - lo).to_pylist()
        lo = hi
