"""Ordered per-key computation that never puts one key into one task.

A station can hold a third of all rows, so ``partitionBy(station)`` is not a
safe window. Three shapes replace it:

* ``number_rows``  - exact position of every row in its key's order. Rows are
  numbered inside (key, time cell) and shifted by a running count over the
  cells, which is a table of one row per cell.
* ``over_chunks``  - row-framed windows with bounded reach. Positions are cut
  into chunks of fixed length; the rows a neighbour chunk can reach are copied
  into it and dropped afterwards, so frames stay exact.
* ``neighbours``   - previous / next marked row at any distance: a scan over
  time cells, blocks of cells and the blocks of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skywharf.session import cut_lineage

HOUR = 3600
DAY = 86400
CHUNK_ROWS = 100_000
#: Rows that a time cell may hold before it is cut narrower.
MOST_ROWS = 10 * CHUNK_ROWS
#: Cells that one window scans at most where marked values are carried along a key.
BLOCK_CELLS = 4096

Stage = Callable[[WindowSpec], dict[str, Column]]


def epoch(time: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp column."""
    return F.unix_seconds(F.col(time) if isinstance(time, str) else time)


def cell_of(time: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(time)) / F.lit(seconds)).cast("long")


def fitting_cell(df: DataFrame, keys: Sequence[str], time: str, widest: int = HOUR, most_rows: int = MOST_ROWS) -> int:
    """Seconds of a cell so that the fullest one holds about ``most_rows`` at most. Runs a job over keys and times.

    Cells are counted at the widest width and narrowed until the fullest fits;
    only its count reaches the driver. Results do not depend on the width.
    """
    width = widest
    while True:
        counts = df.groupBy(*keys, cell_of(time, width).alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
        fullest = counts.agg(F.max("n")).first()[0] or 0
        if fullest <= most_rows or width == 1:
            return width
        width = max(1, min(width // 2, width * most_rows // fullest))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str] = (),
    cell_seconds: int = HOUR,
    position: str = "_rn",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in (keys) order of (time, tie).

    ``total`` names an optional column with the row count of the key.
    """
    keys = list(keys)
    celled = df.withColumn("_cell", cell_of(time, cell_seconds))
    local = F.row_number().over(
        Window.partitionBy(*keys, "_cell").orderBy(F.col(time), *[F.col(c) for c in tie])
    )
    per_cell = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_cell_rows"))
    cells = Window.partitionBy(*keys)
    before = cells.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_cell.select(
        *keys,
        "_cell",
        F.coalesce(F.sum("_cell_rows").over(before), F.lit(0)).alias("_shift"),
        *([F.sum("_cell_rows").over(cells).alias(total)] if total else []),
    )
    return (
        celled.withColumn("_local", local)
        .join(shift, [*keys, "_cell"])
        .withColumn(position, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_cell", "_local", "_shift")
    )


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    stages: Sequence[Stage],
    reach_back: int,
    reach_ahead: int = 0,
    tie: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    cell_seconds: int = HOUR,
    keep_position: bool = False,
) -> DataFrame:
    """Apply window expressions whose frames reach a bounded number of rows.

    Each stage maps the ordered window to new columns; later stages may use
    columns of earlier ones. The reach is the total over all stages. A stage
    can refer to the row position as ``_rn``.
    """
    keys = list(keys)
    size = max(int(chunk_rows), int(reach_back), int(reach_ahead), 1)
    numbered = number_rows(df, keys, time, tie, cell_seconds)
    zero_based = F.col("_rn") - 1
    chunk = F.floor(zero_based / F.lit(size)).cast("long")
    offset = zero_based % F.lit(size)
    homes = [F.struct(chunk.alias("_chunk"), F.lit(False).alias("_copy"))]
    if reach_back:
        homes.append(
            F.when(
                offset >= F.lit(size - reach_back),
                F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_copy")),
            )
        )
    if reach_ahead:
        homes.append(
            F.when(
                (offset < F.lit(reach_ahead)) & (chunk > 0),
                F.struct((chunk - 1).alias("_chunk"), F.lit(True).alias("_copy")),
            )
        )
    spread = (
        numbered.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
        .withColumn("_chunk", F.col("_home._chunk"))
        .withColumn("_copy", F.col("_home._copy"))
        .drop("_home")
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    out = spread
    for stage in stages:
        out = out.withColumns(stage(window))
    out = out.filter(~F.col("_copy")).drop("_copy", "_chunk")
    return out if keep_position else out.drop("_rn")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    payloads: dict[str, Column],
    tie: Sequence[str] = (),
    cell_seconds: int | None = None,
    block_cells: int = BLOCK_CELLS,
    sides: Sequence[str] = ("prev", "next"),
) -> DataFrame:
    """Nearest non-null payload at or before, and at or after, each row.

    Adds ``<name>_prev`` and ``<name>_next`` per payload, or one of ``sides``.
    A scan in three steps: rows look inside their own time cell, cells inside
    their block of ``block_cells`` cells, and blocks along the key; each step
    passes on the first and last marked value of its parts. The rows are
    stored once, and one job over their keys and times finds the widest cell
    whose fullest one stays below MOST_ROWS, down to a second. So however
    crowded an hour is, a window holds few rows of one cell, the cells of one
    block or the blocks of one key. Results do not depend on the widths.
    """
    keys, names, order = list(keys), list(payloads), [time, *tie]
    marked = df.withColumns({f"_mark_{n}": payloads[n] for n in names})
    if cell_seconds is None:
        marked = cut_lineage(marked)
        cell_seconds = fitting_cell(marked, keys, time, DAY)
    celled = marked.withColumn("_cell", cell_of(time, cell_seconds))
    rows = celled.select("*", *_carried(names, [*keys, "_cell"], order, "_mark_", "_mark_", 0, "_own_", sides))
    edge_aggs = []
    for n in names:
        place = F.when(F.col(f"_mark_{n}").isNotNull(), F.struct(*[F.col(c) for c in order]))
        edge_aggs += [F.max_by(f"_mark_{n}", place).alias(f"_last_{n}"), F.min_by(f"_mark_{n}", place).alias(f"_first_{n}")]
    edges = celled.groupBy(*keys, "_cell").agg(*edge_aggs).withColumn("_block", F.floor(F.col("_cell") / block_cells))
    block_aggs = []
    for n in names:
        place = F.when(F.col(f"_last_{n}").isNotNull(), F.col("_cell"))
        block_aggs += [F.max_by(f"_last_{n}", place).alias(f"_last_{n}"), F.min_by(f"_first_{n}", place).alias(f"_first_{n}")]
    blocks = edges.groupBy(*keys, "_block").agg(*block_aggs)
    along = blocks.select(*keys, "_block", *_carried(names, keys, ["_block"], "_last_", "_first_", -1, "_along_", sides))
    inside = edges.select(*keys, "_block", "_cell", *_carried(names, [*keys, "_block"], ["_cell"], "_last_", "_first_", -1, "_inside_", sides))
    carried = inside.join(along, [*keys, "_block"]).select(
        *keys, "_cell", *[F.coalesce(f"_inside_{n}_{side}", f"_along_{n}_{side}").alias(f"_far_{n}_{side}") for n in names for side in sides],
    )
    # Rows without a time or key have no neighbours but stay.
    joined = rows.join(carried, [*keys, "_cell"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(f"_own_{n}_{side}", f"_far_{n}_{side}").alias(f"{n}_{side}") for n in names for side in sides],
    )


def _carried(names: Sequence[str], group: Sequence[str], order: Sequence[str], last: str, first: str, upto: int, out: str, sides: Sequence[str]) -> list[Column]:
    """Last value before and first value after each row of a group; ``upto`` 0 takes the row itself in, -1 does not."""
    window = Window.partitionBy(*group)
    at = {
        "prev": (last, window.orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, upto)),
        "next": (first, window.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, upto)),
    }
    return [F.last(f"{at[side][0]}{n}", ignorenulls=True).over(at[side][1]).alias(f"{out}{n}_{side}") for side in sides for n in names]


def time_grid(df: DataFrame, keys: Sequence[str], time: str, step_seconds: int) -> DataFrame:
    """Every step between the first and last time of each key, empty steps included.

    The span is cut into days before steps are generated, so one long-lived
    key does not build one long array.
    """
    keys = list(keys)
    spans = df.groupBy(*keys).agg(
        F.min(epoch(time)).alias("_lo"), F.max(epoch(time)).alias("_hi")
    )
    lo = F.floor(F.col("_lo") / step_seconds) * step_seconds
    hi = F.floor(F.col("_hi") / step_seconds) * step_seconds
    block = DAY if DAY % step_seconds == 0 else step_seconds
    blocks = spans.select(
        *keys,
        lo.cast("long").alias("_from"),
        hi.cast("long").alias("_to"),
        F.explode(F.sequence(lo.cast("long"), hi.cast("long"), F.lit(block).cast("long"))).alias("_block"),
    )
    end = F.least(F.col("_to"), F.col("_block") + (block - step_seconds))
    steps = blocks.select(
        *keys, F.explode(F.sequence(F.col("_block"), end, F.lit(step_seconds).cast("long"))).alias("_step")
    )
    return steps.select(*keys, F.timestamp_seconds("_step").alias(time))
