"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# one byte for each: separators become a blank, A-Z become a-z, all else (digits, UTF-8 bytes over 0x7F) stays
_FOLD = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
SPACE_WORDS = bytes(32 if c == 32 or 9 <= c <= 13 else _FOLD[c] for c in range(256))
ITEM_WORDS = bytes(_FOLD[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Python also splits bytes at nothing but blanks and 0x09-0x0D, which both tables map to a blank


BATCH_ROWS = 1000  # documents can be long, so Arrow batches hold few of them
BATCH_BYTES = 16 << 20
_HELD: dict[str, Callable[[], None]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch, which takes memory of the executor and of its Python worker alike."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def take_worker(owner: str, clear: Callable[[], None] | None = None) -> None:
    """At the start of a task: drops what tasks of other operators keep in this Python worker. `clear` drops what this one will keep.

    Freed memory goes back to the system: a worker outlives many tasks, and its executor counts what it holds.
    """
    for other in [x for x in _HELD if x != owner]:
        _HELD.pop(other)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
    if clear:
        _HELD[owner] = clear


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, where they don't find it by PYTHONPATH or working folder."""
    bound_batches(spark)
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    reached = [Path(p or ".").resolve() for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in reached or getattr(context, "_lintfleet_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lintfleet-code-"), "lintfleet.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "lintfleet").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._lintfleet_sent = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as it takes for no column (in any letter case) to begin with it."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by the modulus: the fold that decides what may be learned from. Null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, fold: int = 2) -> Column:
    """True for rows that no model may learn from; a null id counts as one that may."""
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(False))


def texts_of(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut to at most `rows` rows, each with its column `text` as Python strings (null: empty)."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")
