"""Operator 10: Hilbert-curve sharding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turns(n: int) -> list[int]:
    """The curve as a state machine over ``n`` dimensions: entry ``state * 2^n + corner`` is ``next * 2^n + digit``.

    A state is the entry corner and the direction of a sub-cube; a digit is the rank of a corner in it.
    """
    side, mask = 1 << n, (1 << n) - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(w): w for w in range(side)}
    low_ones = lambda w: (w ^ (w + 1)).bit_length() - 1  # noqa: E731  trailing ones of w
    table = []
    for state in range(side * n):
        entry, direction = divmod(state, n)
        for corner in range(side):
            w = rank[left(corner ^ entry, n - (direction + 1) % n)]
            start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            turn = 0 if w == 0 else low_ones(w - 1) % n if w % 2 == 0 else low_ones(w) % n
            after = (entry ^ left(start, direction + 1)) * n + (direction + turn + 1) % n
            table.append(after * side + w)
    return table


def with_hilbert(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Append ``out``, the index on the Hilbert curve of the cell given by ``dims`` (each 0 .. 2^bits-1).

    The state machine runs from the top bit down, as one fold over the bit levels.
    """
    n = len(dims)
    table = F.array(*[F.lit(v) for v in _turns(n)])

    def step(acc: Column, level: Column) -> Column:
        corner: Column = F.lit(0)
        for d in dims:
            corner = F.shiftleft(corner, 1).bitwiseOR(F.call_function("shiftright", F.col(d).cast("int"), level).bitwiseAND(F.lit(1)))
        move = F.get(table, F.shiftleft(acc["state"], n).bitwiseOR(corner))
        return F.struct(
            F.shiftright(move, n).alias("state"),
            F.shiftleft(acc["index"], n).bitwiseOR(move.bitwiseAND(F.lit((1 << n) - 1)).cast("long")).alias("index"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    levels = F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)])
    return df.withColumn(out, F.aggregate(levels, start, step, lambda acc: acc["index"]))


def shard(docs: DataFrame, n_shards: int = 16, law: str = "rows", bits: int = 4, part_rows: int = 20_000, most_parts: int = 65_536) -> DataFrame:
    """Deal ``docs`` into runs of the Hilbert order over (source, language, size).

    Source and language are hashed, the size is its binary logarithm; each is quantised to ``bits`` bits, so
    there are at most 2^(3*bits) cells. A cell is split by a hash of doc_id and size into as many parts as it has
    ``part_rows`` (or the ``most_parts``-th part of all rows, if that is more), so that a source with a third of all rows is
    sorted by many tasks; the tables of cells and parts are bounded, whatever the input, and broadcast. The ranks run
    through cells, parts, then doc_id, checksum and size.

    ``law``: "rows" cuts runs whose counts are at most one apart; "bytes" cuts at equal shares of the bytes.
    Equal texts of one source and language are in one cell, but not always in one shard. Null texts count as empty, null ids
    sort first, null sources and languages are a cell of their own, equal rows are interchangeable, an empty table gives no
    rows, further columns are ignored.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be 'rows' or 'bytes'")
    top = (1 << bits) - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit("")).cast("string")), F.lit(top + 1)).alias("__d0"),
        F.pmod(F.xxhash64(F.coalesce(F.col("lang"), F.lit("")).cast("string")), F.lit(top + 1)).alias("__d1"),
    )
    rows = rows.withColumn("__d2", F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit(top)))
    rows = with_hilbert(rows, ["__d0", "__d1", "__d2"], bits, "cell").drop("__d0", "__d1", "__d2")
    # What is before each cell (at most 2^(3*bits) rows), and into how many parts it is cut.
    ahead = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n1"),
        F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b1"),
        F.sum("n").over(everything).alias("n_all"),
        F.sum("b").over(everything).alias("b_all"),
        F.ceil(F.col("n") / F.greatest(F.lit(float(part_rows)), F.sum("n").over(everything) / F.lit(float(most_parts)))).alias("parts"),
    )
    rows = rows.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), "parts")).drop("parts")
    # What is before each part: at most one row a cell and ``most_parts``.
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    parts = parts.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    offsets = parts.join(F.broadcast(cells), "cell").select("cell", "part", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("b0") + F.col("b1")).alias("b0"), "n_all", "b_all")
    inside = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumns({"__r": F.row_number().over(inside) - 1, "__b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    ranked = ranked.join(F.broadcast(offsets), ["cell", "part"]).withColumns({"__r": F.col("__r") + F.col("n0"), "__b": F.col("__b") + F.col("b0")})
    whole = lambda a, b: F.expr(f"cast({a} div {b} as int)")
    if law == "rows":
        ranked = ranked.withColumn("shard", whole(f"(__r * {n_shards}L)", "n_all"))
        first = F.expr(f"(shard * n_all + {n_shards - 1}L) div {n_shards}L")
        ranked = ranked.withColumn("slot", F.col("__r") - first)
    else:
        ranked = ranked.withColumn("shard", whole(f"(__b * {n_shards}L)", "b_all"))
        firsts = ranked.groupBy("shard").agg(F.min("__r").alias("__first"))
        ranked = ranked.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__r") - F.col("__first"))  # n_shards rows
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("hilbert"),
    )
