"""A stream of segments translated over a memory: each text is paid for once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import memory
from docloom.operators.policy import RetryPolicy
from docloom.operators.translate import translate_segments


def write_translations(segs: DataFrame, fn: Callable[[list[str]], list[str]], memory_path: str, path: str, checkpoint: str,
                       policy: RetryPolicy | None = None, batch_size: int = 25, mask: bool = False,
                       text: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Segments with their ``translated`` text; trigger ``n`` overwrites ``path/batch_id=n``.

    A trigger folds its texts, asks only for those that the memory does not hold, stores the
    answers, and then places them. So a trigger that is replayed after its answers were stored
    makes no call, and neither does another stream over texts that are known; what failed stays
    itself here and is asked for again where it comes up next. A memory has one language and one
    writing stream at a time.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        uses = batch.groupBy(text).agg(F.count(F.lit(1)).alias("uses"))
        todo = uses
        if memory.stored(spark, memory_path):
            todo = memory.pending_segments(uses, memory.read_memory(spark, memory_path, [text]), [text])
        done = translate_segments(todo, fn, policy, batch_size, mask=mask, text_col=text, spread=False)
        known = memory.write_memory(done.select(text, "translated", "status"), memory_path, [text], new=True)
        placed = memory.apply_translations(batch, known.select(text, "translated"), [text], text)
        placed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")

    return segs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
