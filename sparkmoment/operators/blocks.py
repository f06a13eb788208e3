"""Many searches at once: each block of queries meets all rows in one task, which keeps the best of them as they pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Queries of a block at most.
BLOCK = 4096
#: Rows that a task looks at together.
CHUNK = 1 << 15

Work = Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.RecordBatch]]


def meet(queries: DataFrame, n: int, rows: DataFrame, order: str, work: Work, schema: T.StructType, block: int = BLOCK) -> DataFrame:
    """What ``work`` gives for each block of the ``n`` queries and all ``rows``, which come to it sorted by ``order``.

    ``work`` gets the queries of its block as a table and the rows as tables of about CHUNK. Rows are repeated for every
    block: one for each ``block`` queries, but no fewer than there are cores; what it holds of a query isn't moved again.
    """
    blocks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-n // block))
    q = queries.withColumns({"__b": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "__row": F.lit(False)})
    r = rows.withColumns({"__b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "__row": F.lit(True)})
    both = q.unionByName(r, allowMissingColumns=True).repartitionById(blocks, F.col("__b"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, first = [], []
        for b in batches:  # queries come first
            cut = len(b) - b.column("__row").true_count
            asked.append(b.slice(0, cut))
            if cut < len(b):
                first = [b.slice(cut)]
                break

        def chunks() -> Iterator[pa.Table]:
            held = first
            for b in batches:
                if sum(map(len, held)) >= CHUNK:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(b)
            if held:
                yield pa.Table.from_batches(held).combine_chunks()

        if any(map(len, asked)):
            yield from work(pa.Table.from_batches(asked).combine_chunks(), chunks())
        for _ in batches:
            pass

    return both.sortWithinPartitions("__row", order).drop("__b").mapInArrow(task, schema)
