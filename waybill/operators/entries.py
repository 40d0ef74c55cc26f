"""Multi-line log entries: continuation lines get the header above them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions import logtext
from waybill.sources.scratch import written

HEAD = ("entry_timestamp", "entry_level")
BLOCK = ("file_path", "block_start")
UNKNOWN = "?"  # stands for "head not in this block" while heads are carried down
IS_BLOCK = "_is_block"  # marks the row that sums up a block


def _carrier():
    """The task-side function. It is made here so that it travels to the
    executors by value: they need pyarrow, but not this package."""
    names, unknown, mark = HEAD, UNKNOWN, IS_BLOCK

    def carry_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fill head columns from the line above, within each block of a file.

        A task gets its blocks one after the other, each in line order. Only the
        last line of a batch is kept. Behind the lines of each block follows one
        row with its last head.
        """
        last = None  # the last line so far, as a batch of one row

        def with_blocks(lines: pa.RecordBatch, ends: pa.Array) -> pa.RecordBatch:
            """Lines, and behind those at the places ``ends`` the row of their block: same block, same heads, no text."""
            n = lines.num_rows
            places = pa.concat_arrays([pa.array(range(n), ends.type), ends])
            order = pc.sort_indices(places)  # stable
            lines, is_block = lines.take(places.take(order)), pc.greater_equal(order, n)
            at = lines.schema.get_field_index("value")
            text = pc.if_else(is_block, pa.scalar(None, lines.schema.field(at).type), lines.column(at))
            lines = lines.set_column(at, lines.schema.field(at), text)
            at = lines.schema.get_field_index(mark)
            return lines.set_column(at, lines.schema.field(at), is_block)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            paths, starts = batch.column("file_path"), batch.column("block_start")
            changed = pc.or_(
                pc.not_equal(paths.slice(1), paths.slice(0, n - 1)),
                pc.not_equal(starts.slice(1), starts.slice(0, n - 1)),
            )
            continues = last is not None and (paths[0], starts[0]) == (last.column("file_path")[0], last.column("block_start")[0])
            opens = pa.concat_arrays([pa.array([not continues]), changed])
            for name in names:
                head = batch.column(name)
                head = pc.if_else(pc.and_(opens, pc.is_null(head)), unknown, head)
                if continues and not head[0].is_valid:
                    above = pa.array([last.column(name)[0].as_py()], head.type)
                    head = pa.concat_arrays([above, head.slice(1)])
                batch = batch.set_column(batch.schema.get_field_index(name), name, pc.fill_null_forward(head))
            if last is not None and not continues:
                yield with_blocks(last, pa.array([0], pa.uint64())).slice(1)
            # a batch holds the ends of many small blocks
            yield with_blocks(batch, pc.indices_nonzero(changed))
            last = batch.slice(n - 1)
        if last is not None:
            yield with_blocks(last, pa.array([0], pa.uint64())).slice(1)

    return carry_down


def _inherited_heads(blocks: DataFrame) -> DataFrame:
    """For each block of a file, the last head ahead of it (null where there is none)."""
    own = F.when(F.col("entry_timestamp") != UNKNOWN, F.struct(*HEAD))
    ahead = (
        Window.partitionBy("file_path").orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocks.select(
        *BLOCK, F.last(own, True).over(ahead).alias("inherited"), F.lit(True).alias("is_known")
    )


def attach_entries(blocks: DataFrame) -> DataFrame:
    """Give every line of a block scan the head line of its entry.

    A head is a line that starts with a time stamp. ``entry_timestamp`` and
    ``entry_level`` are those of the nearest head at or above a line in its
    file; both are null ahead of the first one.

    The text is read once. Heads are carried down inside the blocks as they are read, and the lines
    are written to the shared folder with one more row per block, which holds the block's last head.
    All else works on what was written, so how files were cut, or whether a log has grown since, can't
    make a difference. Only the lines at the start of a block that have no head in it are joined with
    the heads of the blocks ahead; the other lines are not shuffled. A block without its row fails the query.
    """
    stamp = logtext.timestamp_text()
    lines = blocks.select(
        "*",
        F.nullif(stamp, F.lit("")).alias("entry_timestamp"),
        F.when(stamp != "", logtext.log_level()).alias("entry_level"),
        F.lit(False).alias(IS_BLOCK),
    )
    marked = lines.select("*", F.col("entry_timestamp").isNull().alias("is_continuation"))
    filled = written(marked.mapInArrow(_carrier(), marked.schema), "entries")
    text = filled.filter(~F.col(IS_BLOCK))
    is_open = F.col("entry_timestamp") == UNKNOWN
    columns = [*BLOCK, "line_order", "value", "is_continuation"]
    inherited = _inherited_heads(filled.filter(IS_BLOCK))
    missing = F.raise_error(F.concat(F.lit("no row for a block of "), F.col("file_path")))
    opened = text.filter(is_open).join(inherited, list(BLOCK), "left").select(
        *columns,
        *[
            F.when(F.col("is_known"), F.col(f"inherited.{name}")).otherwise(missing.cast("string")).alias(name)
            for name in HEAD
        ],
    )
    return text.filter(~is_open).select(*columns, *HEAD).unionByName(opened)
