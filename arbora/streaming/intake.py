"""Incremental intake of tiles: each tile once, a bad one does not stop the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.ids import normalize_tile_id


def _written(spark: SparkSession, folder: str, but: str) -> DataFrame | None:
    """The ids in the batches under ``folder`` but for one, as a table; None if there is none."""
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return None
    paths = [str(f.getPath()) for f in files.listStatus(home) if f.isDirectory() and f.getPath().getName() != but]
    return spark.read.schema("tile_id string").parquet(*paths) if paths else None


def stepped(rows: DataFrame, step: Callable[[dict], str | None]) -> DataFrame:
    """``rows`` with what ``step`` makes of each (``result``), or what it raised (``error``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    results.append(step(row))
                    errors.append(None)
                except Exception as e:  # whatever a step raises is about its tile
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(result=pd.Series(results, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, result string, error string")


def intake(spark: SparkSession, source: str, schema: str, out: str, rejects: str, checkpoint: str, step: Callable[[dict], str | None] | None = None) -> None:
    """Process the files that arrived under ``source`` since the last call; good tiles go to ``out``, others to ``rejects``.

    ``step``, if given, is called for each good tile with its row as a dict; a tile for which it raises goes to ``rejects`` with the error,
    and may come again. The stream's checkpoint remembers files only; which tiles are done is what ``out`` holds, so the
    stream has no state that grows. A batch that is retried overwrites its own folder, so a tile is written once even if a run is cut short.
    """
    arrived = spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(source)
    named = arrived.withColumn("raw_id", F.col("tile_id")).withColumn("tile_id", normalize_tile_id(F.col("tile_id")))

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("tile_id is not null").dropDuplicates(["tile_id"])
        if (done := _written(spark, out, f"batch={number}")) is not None:
            good = good.join(done, "tile_id", "left_anti").select(*good.columns)
        # Rejected rows are told apart by what they said.
        bad = batch.where("tile_id is null").dropDuplicates(["raw_id"])
        if step is not None:
            # Written first, so that a step is taken once a tile.
            taken = f"{checkpoint}-steps/batch={number}"
            stepped(good, step).write.mode("overwrite").parquet(taken)
            all_ = spark.read.parquet(taken)
            good = all_.where("error is null").drop("error")
            bad = bad.withColumn("error", F.lit("no tile id")).unionByName(all_.where("error is not null").drop("result"))
        good.drop("raw_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        (bad if step is not None else bad.drop("tile_id")).write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    query = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
