"""Incremental work: only what has not been written yet is done, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.operators.merging import not_yet


def resume(df: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` applied to the rows whose key is not among ``done``."""
    return work(not_yet(df, done, key))


def run_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str | None = None, max_files: int = 100) -> None:
    """Process all new files of a folder and stop: files done before are known from the checkpoint, a batch that was cut
    off is repeated, and with ``key`` rows that the target already has are skipped, so a repeated batch writes nothing
    twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if key is not None:
            known = spark.read.schema(target_schema).parquet(target) if _exists(spark, target) else None
            if known is not None:
                # Of the target only the keys are read, once a batch, and cut to those of the batch.
                mine = batch.select(key).distinct()
                rows = batch.join(known.select(key).join(mine, key, "left_semi").distinct(), key, "left_anti")
        work(rows).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    target_schema = work(spark.createDataFrame([], schema)).schema
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


def model_step(df: DataFrame, call: Callable[[list[dict]], list[str]], inputs: list[str], output: str = "raw_model_output", batch: int = 32) -> DataFrame:
    """Rows with the output of an external model. ``call`` gets a list of row dictionaries and returns a text each; it is
    made once a task by calling ``call`` lazily inside the worker, so a model is loaded once and fed in batches."""
    import pyarrow as pa

    kept = df.columns

    def run(batches):
        for b in batches:
            rows = b.select(inputs).to_pylist()
            out = []
            for at in range(0, len(rows), batch):
                out += call(rows[at : at + batch])
            yield b.append_column(output, pa.array(out, pa.string()))

    shape = df.schema.add(output, "string")
    return df.select(*kept).mapInArrow(run, shape)
