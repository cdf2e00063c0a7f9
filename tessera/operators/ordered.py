"""Operators that depend on row order (forward/backward fill, 1..n row
index, running totals, positions inside a class) without a global window.

A window ``ORDER BY key`` with no ``PARTITION BY`` runs in ONE task.  Here
the rows are sorted once by a distributed range sort on the key itself — any
orderable type, compared as that type — and a hash of the row, so that even
rows that share one key spread over many partitions.  The sorted rows are
checkpointed with their place (partition and position), which fixes the
order: a lost executor reads it back.  Each partition is one block of some
``BLOCK_BYTES``: their number comes from the measured bytes of the rows.

What crosses block borders is a prefix scan over (group, block) rows, done on
the executors in two levels: blocks inside runs of ``FAN`` blocks, then the
runs.  Its result joins the rows of each block as one more row in front, so
the window inside a block continues where the earlier blocks ended and no
table of groups or blocks reaches the driver.

Null keys come last.  Rows that share a key are ordered by their hash, the
same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import col, free_name
from tessera.session import cut_lineage

#: Bytes of a block, and blocks of a run of the prefix scan.
BLOCK_BYTES = 64 << 20
FAN = 1024
#: Block tables of at most so many rows (16 bytes each) are broadcast.
BROADCAST_BLOCKS = 200_000
_FIXED = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
_ROW_BYTES = 16


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: fixed widths, and the lengths of everything else,
    in one aggregate that reads only the columns of varying width."""
    fixed, moving = _ROW_BYTES, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.CharType, T.VarcharType)):
            moving.append(F.octet_length(col(f.name)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            moving.append(F.octet_length(F.to_json(F.struct(col(f.name)))))
        else:
            fixed += _FIXED.get(type(f.dataType), 8)
    sums = [F.sum(F.coalesce(x, F.lit(0)).cast("long")).alias(f"b{i}") for i, x in enumerate(moving)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return row["n"] * fixed + sum(row[f"b{i}"] or 0 for i in range(len(moving)))


@dataclass
class Blocks:
    """Rows in order: ``frame`` has, under free names, the number of each
    row's block and its place; ``count`` blocks at most."""
    frame: DataFrame
    block: str
    place: str
    count: int


def with_blocks(df: DataFrame, order_by: str | list[str], blocks: int | None = None) -> Blocks:
    """``df`` in order, cut into blocks (``blocks``: that many instead of as
    many as its bytes ask for)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [*[col(k).asc_nulls_last() for k in keys], F.xxhash64(*[col(c) for c in hashable])]
    blocks = blocks or max(1, -(-measured_bytes(df) // BLOCK_BYTES))
    block, place = (free_name(n, df.columns) for n in ("_block", "_place"))
    ordered = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn(place, F.monotonically_increasing_id()))
    return Blocks(placed.withColumn(block, F.shiftright(place, 33).cast("int")), block, place, blocks)


def _inside(b: Blocks) -> Column:
    """Position in the block, from 0."""
    return F.col(b.place).bitwiseAND((1 << 33) - 1)


def _last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def before(table: DataFrame, block: str, values: list[str], group: str | None = None, last: bool = False) -> DataFrame:
    """For every row (group, block, values) of ``table``, one for each block
    of a group: what the group's earlier blocks add up to (``last``: their
    last value that is not null), in two levels."""
    by = [group] if group else []
    run = free_name("_run", table.columns)
    inner = table.withColumn(run, F.floor(F.col(block) / FAN))
    within = Window.partitionBy(*by, run).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    take = _last if last else F.sum
    whole = ((lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(block)))) if last else (lambda v: F.sum(v)))
    runs = inner.groupBy(*by, run).agg(*[whole(v).alias(v) for v in values])
    runs = runs.select(*by, run, *[take(F.col(v)).over(across).alias(f"{v}_run") for v in values])
    runs = runs.withColumnsRenamed({c: f"{c}_of_run" for c in by + [run]})
    inner = inner.select(*by, block, run, *[take(F.col(v)).over(within).alias(v) for v in values])
    same = inner[run] == runs[f"{run}_of_run"]
    for g in by:
        same = same & inner[g].eqNullSafe(runs[f"{g}_of_run"])
    both = (lambda v: F.coalesce(v, f"{v}_run")) if last else (lambda v: F.coalesce(v, F.lit(0)) + F.coalesce(f"{v}_run", F.lit(0)))
    return inner.join(runs, same).select(*by, block, *[both(v).alias(v) for v in values])


def _in_front(b: Blocks, carries: DataFrame) -> DataFrame:
    """The rows and, in front of each block, one row with what the earlier
    blocks hand on (columns of ``carries``; no place of its own)."""
    return b.frame.unionByName(carries.withColumn(b.place, F.lit(-1).cast("long")), allowMissingColumns=True)


def ffill_bfill(df: DataFrame, columns: list[str], order_by: str | list[str], blocks: int | None = None) -> DataFrame:
    """Forward fill then backward fill of ``columns`` in ``order_by`` order."""
    if not columns:
        return df
    b = with_blocks(df, order_by, blocks)
    found = {c: F.when(col(c).isNotNull(), F.col(b.place)) for c in columns}
    names = {c: (f"_first{i}", f"_last{i}") for i, c in enumerate(columns)}
    edges = cut_lineage(b.frame.groupBy(b.block).agg(
        *[F.min_by(col(c), found[c]).alias(names[c][0]) for c in columns],
        *[F.max_by(col(c), found[c]).alias(names[c][1]) for c in columns]))
    # rows before the first value take that value: one row for the whole table
    first = edges.agg(*[F.min_by(names[c][0], F.when(F.col(names[c][0]).isNotNull(), F.col(b.block))).alias(names[c][0]) for c in columns])
    carried = before(edges.drop(*[names[c][0] for c in columns]), b.block, [names[c][1] for c in columns], last=True)
    carries = carried.crossJoin(F.broadcast(first)).select(b.block, *[F.coalesce(names[c][1], names[c][0]).alias(c) for c in columns])
    w = Window.partitionBy(b.block).orderBy(b.place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = _in_front(b, carries).withColumns({f"_filled{i}": _last(col(c)).over(w) for i, c in enumerate(columns)})
    new = {c: F.col(f"_filled{i}").alias(c) for i, c in enumerate(columns)}
    return filled.where(F.col(b.place) >= 0).select(*[new.get(c, col(c)) for c in df.columns])


def _offsets(b: Blocks) -> DataFrame:
    """(block, rows of all earlier blocks), under free names."""
    sizes = cut_lineage(b.frame.groupBy(b.block).agg(F.count(F.lit(1)).alias("_before")))
    out = before(sizes, b.block, ["_before"]).withColumnRenamed(b.block, f"{b.block}_of")
    return F.broadcast(out) if b.count <= BROADCAST_BLOCKS else out


def row_index(df: DataFrame, order_by: list[str] | str, name: str = "row_idx",
              blocks: int | None = None) -> DataFrame:
    """1..n in ``order_by`` order: the place in its block plus the number
    of rows in all earlier blocks."""
    b = with_blocks(df, order_by, blocks)
    offsets = _offsets(b)
    joined = b.frame.join(offsets, b.frame[b.block] == offsets[f"{b.block}_of"])
    return joined.select((_inside(b) + offsets["_before"] + 1).cast("long").alias(name), *[b.frame[_quoted(c)] for c in df.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """``(key, index)`` with index 0..k-1 over the sorted distinct keys."""
    keys = df.select(col(key).alias(key)).where(col(key).isNotNull()).distinct()
    return row_index(keys, key, name).select(col(key).alias(key), (F.col(name) - 1).alias(name))


def running_total(df: DataFrame, order_by: str | list[str], value: str, name: str = "running",
                  inclusive: bool = False, blocks: int | None = None, group: str | None = None) -> DataFrame:
    """Sum of ``value`` over all rows before (``inclusive``: up to and
    including) each row in ``order_by`` order — within each ``group`` if
    given.  Blocks are cut on ``order_by`` over all groups; a group's carry
    into a block is the scan over its blocks, so any number of groups and
    blocks stays on the executors."""
    b = with_blocks(df, order_by, blocks)
    kind = b.frame.schema[value].dataType
    by = [] if group is None else [group]
    sums = cut_lineage(b.frame.groupBy(*[col(g) for g in by], b.block).agg(F.sum(col(value)).alias("_sum")))
    carries = before(sums, b.block, ["_sum"], group).select(*[col(g) for g in by], b.block, F.col("_sum").cast(kind).alias(value))
    w = (Window.partitionBy(*[col(g) for g in by], b.block).orderBy(b.place)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    total = F.coalesce(F.sum(col(value)).over(w), F.lit(0)).cast(kind).alias(name)
    out = _in_front(b, carries).select(*[col(c) for c in df.columns], total, b.place)
    return out.where(F.col(b.place) >= 0).drop(b.place)


def class_positions(df: DataFrame, order_by: str | list[str], group: str, name: str = "position",
                    blocks: int | None = None) -> DataFrame:
    """Add the position (from 0) of every row among the rows of its
    ``group`` in ``order_by`` order.  A class may hold most of the rows: it
    is spread over the blocks, and none of them is larger than the others."""
    one = free_name("_one", df.columns)
    return running_total(df.withColumn(one, F.lit(1).cast("long")), order_by, one, name, blocks=blocks, group=group).drop(one)
