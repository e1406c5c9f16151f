"""Readers and writers of corpora, indexes, reports and logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sparse import Index

#: Rows of a Parquet file's row groups and files of a sink, as readers that stream expect them.
ROW_GROUP_ROWS = 4000


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """A Parquet table; only the named columns (also nested ones, as ``passages.is_selected``) are read."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a small table comes in fewer splits than those; a larger one is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, lengths and times of change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return hashlib.md5(repr(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)).encode()).hexdigest()


def read_with_position(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table with ``source_file`` and ``row_index``, each row's place in its file."""
    return spark.read.parquet(path).select(*(columns or ["*"]), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))


def head_of_column(spark: SparkSession, path: str, column: str, rows: int) -> DataFrame:
    """The first rows of one column, nested or not."""
    return spark.read.parquet(path).select(column).limit(rows)


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, size): by file of a Parquet table, without its columns."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    return files.groupBy(F.col("file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("file_size").alias("size"))


def footers(spark: SparkSession, path: str, most_files: int = 10_000) -> DataFrame:
    """(file, row_group, rows, bytes, fields) from the footers of a Parquet table's files; no column is read.

    The driver opens each file's end by Spark's own file systems; fails beyond ``most_files``.
    """
    names = [r.file for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file")).limit(most_files + 1).collect()]
    if len(names) > most_files:
        raise ValueError(f"more than {most_files} files; name a part of the table")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(names):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        try:
            fields = reader.getFooter().getFileMetaData().getSchema().toString()
            out += [(name, i, b.getRowCount(), b.getTotalByteSize(), fields) for i, b in enumerate(reader.getFooter().getBlocks())]
        finally:
            reader.close()
    return spark.createDataFrame(out, "file string, row_group int, rows long, bytes long, fields string")


def assert_dimension(vectors: DataFrame, path: str, vector: str = "vector") -> None:
    """Fails if the vectors of a new table and of the one at ``path`` differ in length; passes if there is none."""
    spark = vectors.sparkSession
    if exists(spark, f"{path}/_SUCCESS"):
        held, new = (df.select(F.size(vector).alias("n")).limit(1).collect() for df in (spark.read.parquet(path), vectors))
        if held and new and held[0].n != new[0].n:
            raise ValueError(f"vectors of {new[0].n} dimensions for a table of {held[0].n}; drop it first")


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder, to be written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", rows_per_file: int = 0) -> None:
    """A zstd Parquet table."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new``, and of ``existing`` the rows whose key it lacks; doing it twice changes nothing."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def write_index(index: Index, path: str) -> None:
    """An index's tables below ``path``; postings lie by language and term, so that a join reads the row groups it needs. ``terms`` comes last and completes it."""
    index.postings.repartition("lang", "term").sortWithinPartitions("lang", "term").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("lengths", "stats", "terms"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_index(spark: SparkSession, path: str, build: Callable[[], Index] | None = None) -> Index:
    """The index below ``path``; built and written first if it is not there and ``build`` is given."""
    if build is not None and not exists(spark, f"{path}/terms/_SUCCESS"):
        write_index(build(), path)
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "stats", "terms")])


def readiness(spark: SparkSession, artefacts: dict[str, str]) -> DataFrame:
    """(artefact, path, ready) of what serving needs."""
    return spark.createDataFrame([(n, p, exists(spark, p)) for n, p in artefacts.items()], "artefact string, path string, ready boolean")


def append_log(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, after those that are there."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(report: DataFrame, path: str, most_rows: int = 10_000) -> None:
    """A small result as one JSON document in any file system that Spark knows; fails beyond ``most_rows``."""
    rows = [r.asDict(recursive=True) for r in report.limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows; write it as a table")
    text = json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    jvm, spark = report.sparkSession.sparkContext._jvm, report.sparkSession
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def markdown(report: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a Markdown table."""
    line = lambda cells: f"| {' | '.join(str(c) for c in cells)} |"
    rows = report.limit(most_rows).collect()
    return "\n".join([line(report.columns), line(["---"] * len(report.columns)), *[line(["" if c is None else c for c in r]) for r in rows]])


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploads: path, bytes and size."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
