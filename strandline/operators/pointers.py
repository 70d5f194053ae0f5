"""Which rows are reached from a domain's first row, when every row points to a later one.

Following pointers one by one is sequential. Here a domain is cut into cells of time, and a cell, seen from outside, is a
table: from each row at which it can be entered to the row outside at which the walk lands. Cells are tables with far
fewer rows than the cell has, some of them make a larger cell in the same way, and so on, until a domain is one cell. Then
the way back: where each larger cell is entered says where each cell in it is entered, down to the rows themselves. So no
task ever holds more than one cell of some level, and the number of passes grows with the logarithm of the time span.

Where pointers lead out of a cell from most of its rows, its table is no smaller than it is. Tables are counted before they
are put together, and the larger they are, the fewer make a larger cell; at least two do. So a cell's table has at most the
rows that are pointed to across its border, and a task holds MERGED times `most` rows, or two such tables.

In a task many cells are walked at once, by numpy. All levels are written, so that a lost executor costs one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.scan import CELL, SPLITS, Cells
from strandline.sources.checkpoints import cut

#: Cells that make one cell of the next level at most, as a power of two.
FAN_BITS = 6
#: Rows of the tables that make one cell of the next level, in times of `most`.
MERGED = 8
#: Rows that a task takes into Python at a time, and rows of a cell beyond which it is split.
WALK_ROWS = 1 << 15
DOOR = "_door"
SPLIT_BITS = SPLITS.bit_length() - 1


def steps_of(cells: pa.Table, key: str, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the row that each row points to, or -1 if that is outside its cell; the cells' codes)."""
    code = cells.select(groups).to_pandas().groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
    keys = cells.column(key).to_pandas()
    at = pd.MultiIndex.from_arrays([code, keys])
    to = cells.column("_to_key")
    inside = np.asarray(cells.column("_inside").to_pandas(), dtype=bool)
    wanted = to.take(pa.array(np.flatnonzero(inside))).to_pandas()
    step = np.full(len(code), -1, dtype=np.int64)
    step[inside] = at.get_indexer(pd.MultiIndex.from_arrays([code[inside], wanted]))
    return step, code


def places_of(cells: pa.Table, code: np.ndarray, entered: pa.Table, key: str, groups: list[str]) -> np.ndarray:
    """Places of the rows at which the cells are entered."""
    left = cells.select([*groups, key]).to_pandas()
    left["_place"] = np.arange(len(left))
    doors = entered.rename_columns([c.removeprefix(DOOR) for c in entered.schema.names])
    return doors.select([*groups, key]).to_pandas().drop_duplicates().merge(left, on=[*groups, key], how="inner")["_place"].to_numpy()


def reached(rows: DataFrame, by: Sequence[str], time: str, key: str, to_time: str, to_key: str, width: int, most: int = WALK_ROWS) -> DataFrame:
    """Those rows that are on the way from each domain's first row, by (time, key). A null pointer ends the way.

    key is unique in a domain, and (to_time, to_key) is a later row of it.
    """
    by = list(by)
    names = rows.columns
    cells = Cells(rows, by, time, width, most)
    extra = [c for c in names if c not in {*by, time, key, to_time, to_key}]
    level0 = cells.put(cells.put(rows, time), to_time, "_to_cell").select(*by, time, key, CELL, "_to_cell", F.col(to_time).alias("_to_time"), F.col(to_key).alias("_to_key"), *extra)
    level0 = cut(level0)
    first = level0.groupBy(*by).agg(F.min_by(F.struct(key, CELL), F.struct(time, key)).alias("_first")).select(*by, "_first.*")
    wide = F.call_function("shiftright", F.col(CELL), F.lit(SPLIT_BITS))
    span = level0.agg(F.min(wide).alias("low"), F.max(wide).alias("high"), F.max(F.expr(f"{CELL} & {SPLITS - 1}")).alias("part"), F.count("*").alias("n")).first()
    if not span["n"]:
        return rows
    top = ((span["high"] - span["low"]) << SPLIT_BITS) + span["part"]

    def cell(bits: int, name: str) -> Column:
        """A cell's number without its last bits is the number of the larger cell that it lies in."""
        return F.call_function("shiftright", F.col(name) - (span["low"] << SPLIT_BITS), F.lit(bits))

    def wider(bits: int, table: DataFrame) -> int:
        """Bits of the next level, when cells have these tables."""
        largest = table.groupBy(*by, cell(bits, CELL).alias("_group")).count().agg(F.max("count")).first()[0] or 1
        fan = min(max((MERGED * most // largest).bit_length() - 1, 1), FAN_BITS)
        parts = span["part"].bit_length()
        if bits < parts:
            bits = min(bits + fan, parts)
            return SPLIT_BITS if bits == parts else bits
        return min(max(bits, SPLIT_BITS) + fan, top.bit_length())

    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-span["n"] // most))
    groups = [*by, "_group"]

    def dealt(df: DataFrame, bits: int) -> DataFrame:
        grouped = df.withColumn("_group", cell(bits, CELL))
        return grouped.withColumn("_bucket", F.pmod(F.xxhash64(*groups), F.lit(buckets)))

    def walk(df: DataFrame, bits: int, entered: DataFrame, every: bool) -> DataFrame:
        """every: all rows on the way from where cells are entered. Else: only these, pointing to where the walk lands."""
        inside = dealt(df, bits).withColumn("_inside", F.coalesce(F.col("_group") == cell(bits, "_to_cell"), F.lit(False)))
        columns = df.columns

        def run(cells: pa.Table, doors: pa.Table) -> pa.Table:
            if not len(cells) or not len(doors):
                return cells.select(columns).slice(0, 0)
            step, code = steps_of(cells, key, groups)
            at = places_of(cells, code, doors, key, groups)
            if every:
                seen = np.zeros(len(step), dtype=bool)
                while len(at):
                    at = at[~seen[at]]
                    seen[at] = True
                    at = step[at]
                    at = at[at >= 0]
                return cells.select(columns).take(pa.array(np.flatnonzero(seen)))
            last = np.where(step < 0, np.arange(len(step)), step)
            while True:
                further = last[last]
                if (further == last).all():
                    break
                last = further
            out = cells.select(columns).take(pa.array(at))
            landing = pa.array(last[at])
            for c in ("_to_cell", "_to_time", "_to_key"):
                out = out.set_column(out.schema.get_field_index(c), out.schema.field(c), cells.column(c).take(landing))
            return out

        # Both sides come from one table: columns under new names keep them apart.
        doors = dealt(entered, bits).select(*[F.col(c).alias(f"{DOOR}{c}") for c in ("_bucket", *groups, key)])
        return inside.groupBy("_bucket").cogroup(doors.groupBy(f"{DOOR}_bucket")).applyInArrow(run, df.schema)

    levels = [(level0, 0)]
    while top >> levels[-1][1]:
        here, bits = levels[-1]
        crossing = here.where(cell(bits, CELL) != cell(bits, "_to_cell")).select(*by, F.col("_to_key").alias(key), F.col("_to_cell").alias(CELL)).distinct()
        bare = here.select(*by, time, key, CELL, "_to_cell", "_to_time", "_to_key")
        table = cut(walk(bare, bits, crossing.unionByName(first), every=False))
        levels.append((table, wider(bits, table)))
    doors = first
    for table, bits in reversed(levels):
        doors = walk(table, bits, doors, every=True)
        if bits:
            doors = cut(doors)
    return doors.withColumnsRenamed({"_to_time": to_time, "_to_key": to_key}).select(*names)
