"""Ordered position and predecessor within groups, safe for hot groups.

A plain ``Window.partitionBy(group)`` sends every row of a group to one task;
when one session holds a third of all rows that task holds a third of the data.
Here the rows of a hot group are dealt to cells, contiguous in the group's
order, and the window runs in (group, cell):

1. group counts (map-side combined) tell which groups are larger than a task
   should be; there are at most ``4 * partitions`` of them;
2. a hashed sample of their keys, in order, gives each its cut points;
3. every row gets its cell (0 in all other groups) from the broadcast cut
   points, and one exchange by (group, cell) brings each cell to a task;
4. only a cell's first rows can continue another cell, so count and last key of
   each cell of the hot groups, one row a cell, are summed in order and joined
   back by broadcast.

So the rows are exchanged once, whether a group is hot or not; without a hot
group the plan is the plain window. The same cells give :func:`latest_before`,
an as-of join that carries the latest right-side row forward.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a group from which on it may be cut into cells.
CELL_ROWS = 200_000
#: Sampled keys for each cell of a hot group.
_SAMPLES = 16


def _use_cells(mode: str, num_slices: int | None) -> bool:
    if mode not in ("sliced", "window"):
        raise ValueError(f"mode must be sliced or window, not {mode!r}")
    return mode == "sliced" or bool(num_slices)


def _cut_points(df: DataFrame, group_cols: list[str], order: Column, num_slices: int | None) -> DataFrame | None:
    """For each hot group its cut points in two levels: ``_coarse``, every
    ``_width``-th of ``_cuts``. None if no group is hot.

    The table holds at most 4 cut points a partition over all groups and is
    checkpointed, as several steps must see the same cuts.
    """
    spark = df.sparkSession
    cells = 4 * (num_slices or int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.lit(1)).count()
    size = max(1 if num_slices else CELL_ROWS, total // cells)
    hot = counts.where(F.col("_n") > size).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(group_cols)])
    ensure_checkpoint_dir(spark)
    hot = hot.checkpoint(eager=True)  # fewer than total / size rows: at most ``cells``
    if hot.isEmpty():
        return None
    same = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(group_cols)]
    keys = df.select(*group_cols, order.alias("_o"))
    sample = keys.where(F.pmod(F.xxhash64("_o"), F.lit(max(1, size // _SAMPLES))) == 0).join(F.broadcast(hot), same)
    # every _SAMPLES-th sampled key is a cut point
    every = min(_SAMPLES, size)
    cuts = (sample.groupBy(*[f"_h{i}" for i in range(len(group_cols))]).agg(F.sort_array(F.collect_list("_o")).alias("_s"))
            .withColumn("_cuts", F.filter("_s", lambda x, i: i % every == every - 1)))
    width = isqrt(cells) + 1
    return (cuts.withColumn("_coarse", F.filter("_cuts", lambda x, i: i % width == width - 1))
            .withColumn("_width", F.lit(width)).drop("_s").checkpoint(eager=True))


def _with_cells(df: DataFrame, group_cols: list[str], order: Column, cuts: DataFrame) -> DataFrame:
    """``df`` with ``_cell``: how many cut points of its group are below the
    row's key; null in groups that are not hot."""
    same = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(group_cols)]
    met = df.withColumn("_o", order).join(F.broadcast(cuts), same, "left")
    blocks = F.size(F.filter("_coarse", lambda c: c < F.col("_o")))
    within = F.filter(F.slice("_cuts", F.col("_block") * F.col("_width") + 1, F.col("_width")), lambda c: c < F.col("_o"))
    # the number of whole blocks below the key, then the cut points of the next one
    return (met.withColumn("_block", F.when(F.col("_cuts").isNotNull(), blocks))
               .withColumn("_cell", F.col("_block") * F.col("_width") + F.size(within))
               .drop("_o", "_cuts", "_coarse", "_width", "_block", *[f"_h{i}" for i in range(len(group_cols))]))


def _joined_back(cells: DataFrame, group_cols: list[str], stats: DataFrame) -> DataFrame:
    """Rows with what ``stats`` (``_g0``, ..., ``_gcell``) says of their cell."""
    same = [F.col("_cell") == F.col("_gcell")] + [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)]
    return cells.join(F.broadcast(stats), same, "left").drop("_gcell", *[f"_g{i}" for i in range(len(group_cols))])


def _cell_stats(cells: DataFrame, group_cols: list[str], *aggs: Column) -> tuple[DataFrame, Window]:
    """One row a cell of the hot groups, and the window over a group's cells."""
    stats = (cells.where(F.col("_cell").isNotNull())
             .groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], F.col("_cell").alias("_gcell")).agg(*aggs))
    return stats, Window.partitionBy(*[f"_g{i}" for i in range(len(group_cols))]).orderBy("_gcell")


def sequence_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[str],
                           seq_col: str = "seq", prev_prefix: str | None = "prev_",
                           num_slices: int | None = None, carry_cols: list[str] = (),
                           mode: str = "sliced") -> DataFrame:
    """Add ``seq`` (1-based position) and ``prev_<col>`` for order and carry columns.

    ``order_cols`` must give a total order within a group (add a unique id as
    the last column) so results are deterministic on recomputation; rows equal
    in all of them stay in one cell. NULLs sort last, as in pandas and SQL
    ``ASC``: each order column is preceded by its ``IS NULL`` flag, so cut
    points, windows and the cells' last keys all see one and the same order.
    NULL groups are a group of their own. ``num_slices`` sets the number of
    tasks to deal the rows to; ``mode="window"`` is a plain window with the
    same result, for a caller who knows that every group fits into one task.
    """
    use_cells = _use_cells(mode, num_slices)
    flags = [f"_nl{i}" for i in range(len(order_cols))]
    eff_order = [x for pair in zip(flags, order_cols) for x in pair]
    df = df.select("*", *[F.col(c).isNull().alias(f) for c, f in zip(order_cols, flags)])
    order = F.struct(*[F.col(c) for c in eff_order])
    cuts = _cut_points(df, group_cols, order, num_slices) if use_cells else None
    cells = _with_cells(df, group_cols, order, cuts) if cuts is not None else df
    w = Window.partitionBy(*group_cols, *(["_cell"] if cuts is not None else [])).orderBy(*eff_order)
    taken = [*order_cols, *carry_cols] if prev_prefix is not None else []
    out = cells.withColumn(seq_col, F.row_number().over(w).cast("long"))
    if taken:
        # one struct, so that a predecessor with null columns is still one
        out = out.withColumn("_prev", F.lag(F.struct(*[F.col(c) for c in taken])).over(w))
    if cuts is not None:
        last = F.max(F.struct(*[F.col(c) for c in [*eff_order, *[c for c in taken if c not in order_cols]]]))
        stats, across = _cell_stats(cells, group_cols, F.count(F.lit(1)).alias("_n"), last.alias("_last"))
        stats = stats.select("*", F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
                             F.lag("_last").over(across).alias("_before")).drop("_n", "_last")
        out = _joined_back(out, group_cols, stats).withColumn(seq_col, F.col(seq_col) + F.coalesce("_off", F.lit(0)))
        if taken:
            of = F.when(F.col("_before").isNotNull(), F.struct(*[F.col("_before").getField(c).alias(c) for c in taken]))
            out = out.withColumn("_prev", F.coalesce("_prev", of))
        out = out.drop("_off", "_before", "_cell")
    for c in taken:
        out = out.withColumn(f"{prev_prefix}{c}", F.col("_prev").getField(c))
    return out.drop("_prev", *flags)


def latest_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
                  right_tiebreak: str, right_cols: list[str], prefix: str = "right_",
                  mode: str = "sliced") -> DataFrame:
    """As-of join: each ``left`` row with the latest ``right`` row of the same
    ``key`` whose time is at or before the left row's time (ties on time: the
    greatest ``right_tiebreak``). Left rows without one get NULLs.

    No pairs are formed. Both sides are stacked into one stream ordered by
    (key, time, side, tiebreak) — right rows first at equal times — and a hot
    key is dealt to cells. Within a cell the last right row seen so far is
    carried forward by a window; across cells, the last right row of earlier
    cells of the key comes from a table of one row a cell. Output: left columns
    plus ``prefix + c`` for each right column. ``mode`` as in
    :func:`sequence_within_groups`.
    """
    rstruct = F.struct(F.col("_t").alias("_t"), F.col("_tb").alias("_tb"),
                       *[F.col(f"_r_{c}").alias(c) for c in right_cols])
    lcols = left.columns
    # left rows at one time are ordered by a hash, so that cells can part them
    l_side = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                         F.xxhash64(*lcols).cast("string").alias("_tb"),
                         *[F.col(c).alias(f"_l_{c}") for c in lcols],
                         *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in right_cols])
    # a NULL key never equals anything (SQL semantics): such right rows cannot match
    r_side = right.where(F.col(key).isNotNull()).select(
                          F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                          F.col(right_tiebreak).cast("string").alias("_tb"),
                          *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in lcols],
                          *[F.col(c).alias(f"_r_{c}") for c in right_cols])
    stacked = l_side.unionByName(r_side).where(F.col("_t").isNotNull())
    order_cols = ["_t", "_side", "_tb"]
    order = F.struct(*order_cols)
    right_row = F.when(F.col("_side") == 0, rstruct)
    # NULL left times never match; such rows are added back at the end
    nulls = left.where(F.col(left_time).isNull()).select(
        *lcols, *[F.lit(None).cast(right.schema[c].dataType).alias(f"{prefix}{c}") for c in right_cols])
    cuts = _cut_points(stacked, ["_k"], order, None) if _use_cells(mode, None) else None
    cells = _with_cells(stacked, ["_k"], order, cuts) if cuts is not None else stacked
    upto = Window.partitionBy("_k", *(["_cell"] if cuts is not None else [])).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cells.withColumn("_m", F.last(right_row, ignorenulls=True).over(upto)).where(F.col("_side") == 1)
    if cuts is not None:
        stats, across = _cell_stats(cells, ["_k"], F.max(right_row).alias("_last"))
        stats = stats.select("*", F.last("_last", ignorenulls=True).over(
            across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")).drop("_last")
        found = _joined_back(found, ["_k"], stats).withColumn("_m", F.coalesce("_m", "_before"))
    out = found.select(*[F.col(f"_l_{c}").alias(c) for c in lcols],
                       *[F.col("_m").getField(c).alias(f"{prefix}{c}") for c in right_cols])
    return out.unionByName(nulls)
