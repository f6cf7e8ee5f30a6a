"""A drop folder as a stream: new files become catalogue rows once, however often a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.catalog import classify_title, url_basename
from lectern.operators.resources import identify

BINARY = "path string, modificationTime timestamp, length long, content binary"


def read_drop_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(folder)


def catalogue_rows(files: DataFrame, board: str, qualification: str, code: str) -> DataFrame:
    """``path, title, type, year, session, paper, variant, resource_id, subject_id, bytes, digest`` of each file."""
    title = F.regexp_replace(F.regexp_replace(url_basename(F.col("path")), r"\.[A-Za-z]+\z", ""), "[-_]+", " ")
    told = files.select("path", title.alias("title"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest")).withColumn("_c", classify_title(F.col("title")))
    return identify(told.select("path", "title", "bytes", "digest", "_c.*"), board, qualification, code)


def store_new(batch: DataFrame, target: str) -> None:
    """Appends the rows whose path isn't stored yet; a batch that is run again adds nothing.

    Only the stored table's paths are read. One writer at a time: a stream's batches follow each other.
    """
    spark = batch.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    new = batch.dropDuplicates(["path"])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.schema("path string").parquet(target), "path", "left_anti")
    new.write.mode("append").parquet(target)


def catalogue_stream(files: DataFrame, target: str, checkpoint: str, board: str, qualification: str, code: str) -> StreamingQuery:
    """Starts the stream over what is there now; ends when that is stored."""
    rows = catalogue_rows(files, board, qualification, code)
    return rows.writeStream.foreachBatch(lambda batch, _: store_new(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
