"""Shared helpers: document scans in Arrow batches, written cut points, grouped streams, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets one of its own; a cluster has none to offer."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that nothing before it is computed again. ``sweep`` removes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Remove all that ``cut`` has written so far in this process; for when the results built on it are stored. The number of tables removed."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def forget(df: DataFrame) -> None:
    """Remove a table that ``cut`` has written, now that nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def joinable(df: DataFrame, name: str, most_bytes: int = 32 << 20) -> DataFrame:
    """``df``, written, to be joined with: broadcast if its rows were found to take ``most_bytes`` or less, else left to a shuffle."""
    written = cut(df, name)
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    taken = written.agg(F.sum(sum(wide, F.lit(16 + 8 * len(df.columns)))).alias("b")).first()["b"]
    return F.broadcast(written) if (taken or 0) <= most_bytes else written


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``max_bytes`` bytes together (one row at least)."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def scan_texts(
    docs: DataFrame,
    fn: Callable[[list[pa.Array]], Iterable[pa.RecordBatch]],
    schema: str | StructType,
    columns: tuple[str, ...] = ("doc_id", "text"),
    max_bytes: int = 4 << 20,
) -> DataFrame:
    """``fn`` over the named columns of ``docs`` (the last is the text; null reads as empty) in bounded batches."""
    chosen = docs.select(*[F.col(f"`{c}`") for c in columns[:-1]], F.coalesce(F.col(f"`{columns[-1]}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, max_bytes):
                yield from fn(part.columns)

    return chosen.mapInArrow(run, schema)


def grouped(
    df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterable[pa.RecordBatch]], schema: str, presorted: list[str] | None = None
) -> DataFrame:
    """``fn(key, rows)`` once per key. Rows are dealt by key and sorted, then streamed: a task holds one group at a time."""
    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(presorted or []))
    width = len(keys)
    names = df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in at:
                col = batch.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= col[1:] != col[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in at)
                if held and key != held_key:
                    yield from fn(held_key, pa.Table.from_batches(held))
                    held = []
                held_key = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(held_key, pa.Table.from_batches(held))

    assert width
    return dealt.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, root), root the least id of the component.

    All that one id is joined to hangs on the least of it, so that many edges become few. Then, each round, every node takes
    the least root next to it, and the root of its root; roots are written to the shared folder, and only their count of
    changes comes to the driver. Ids without edges get no row.
    """
    edges = edges.select("a", "b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    few = cut(least.select("a", F.col("m").alias("b")).union(edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "few")
    both = cut(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    for _ in range(rounds):
        seen = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        near = roots.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = cut(near.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots")
        changed = after.where("root != old").limit(1).count()
        roots = after.select("id", "root")
        if not changed:
            return roots
    # A very long chain: go on with the roots so far as nodes.
    at = lambda old, new: roots.select(F.col("id").alias(old), F.col("root").alias(new))
    further = components(both.join(at("a", "x"), "a").join(at("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), rounds)
    return roots.withColumnRenamed("root", "mid").join(further.withColumnRenamed("id", "mid"), "mid").select("id", "root")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the n+1 offsets of the texts in it."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if texts.type in (pa.string(), pa.binary()) else np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_runs(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, rows: int = 20_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``fn`` over runs of whole groups, about ``rows`` rows or ``most_bytes`` bytes at a time: for many small groups. Rows are dealt and sorted by key."""
    dealt = df.repartition(F.col(key)).sortWithinPartitions(key)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            # A batch of long texts is taken in parts, so that runs keep to their bytes.
            step = max(1, whole.num_rows * most_bytes // (4 * max(1, whole.nbytes)))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                col = batch.column(at).to_numpy(zero_copy_only=False)
                if held and (sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most_bytes):
                    same = col == held[-1].column(at)[held[-1].num_rows - 1].as_py()
                    lead = batch.num_rows if same.all() else int(np.argmin(same))
                    if lead:
                        held.append(batch.slice(0, lead))
                    if lead == batch.num_rows:
                        continue
                    yield from fn(pa.Table.from_batches(held))
                    held, batch = [], batch.slice(lead)
                held.append(batch)
        if held:
            yield from fn(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)
