"""Groups cut into blocks, and block pairs dealt to tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from syllabix.llm.common import shuffle_partitions
from syllabix.session import ship_package

KEYS = ["_group", "_i", "_j"]


def block_pairs(rows: DataFrame, group: str, blocks: Column, item: str) -> DataFrame:
    """Every row once per block pair of its group that its block takes part in.

    ``blocks`` is the group's number of blocks and the block comes from a hash of
    ``item``. Adds ``_group``, ``_i``, ``_j`` (``_i <= _j``) and ``_side``, the row's own
    block. Together the pairs cover all pairs of rows, each in one task, and no task
    holds more than two blocks of a group.
    """
    return (
        rows.withColumn("_blocks", blocks.cast("int"))
        .withColumn("_side", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            F.col(group).alias("_group"), F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
            "_side", *[c for c in rows.columns if c != group],
        )
    )


def map_block_pairs(rows: DataFrame, function: Callable[[pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """``function`` on the rows of every block pair.

    Rows are hashed by the pair and sorted, and each task walks through its pairs in
    order, so it holds one Arrow batch and one unfinished pair.
    """
    ship_package(rows.sparkSession)
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
        out = function(part)
        if out and out[target.names[0]]:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if rest is not None:
                part = pa.concat_tables([rest, part]).combine_chunks()
            starts = _starts(part)
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 1:
                    yield from emit(part.slice(a, b - a))
            rest = part.slice(starts[-1]) if len(starts) else None
        if rest is not None and rest.num_rows > 1:
            yield from emit(rest)

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, schema)


def _starts(part: pa.Table) -> list[int]:
    """First row of every block pair."""
    if not part.num_rows:
        return []
    changed = None
    for key in KEYS:
        values = part.column(key).combine_chunks()
        differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
        changed = differs if changed is None else pc.or_(changed, differs)
    return [0, *(pc.indices_nonzero(changed).to_numpy() + 1).tolist()]
