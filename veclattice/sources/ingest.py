"""Sources of texts and ids, through Spark's readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyInput
from ..functions.text import trim

#: File name extensions that are read as text.
EXTENSIONS = "txt md swift json xml html css js ts py rs go java kt c h cpp hpp".split()


def directory(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """document_name, file_path and text of the files of one folder, without hidden ones and blank texts, by name; none left is an error."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{path.rstrip('/')}/*")
    except AnalysisException as e:
        raise EmptyInput(f"no file in {path}") from e
    name = F.regexp_extract("path", "([^/]+)$", 1)
    wanted = "(?i)\\.(" + "|".join(extensions or EXTENSIONS) + ")$"
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = files.select(name.alias("document_name"), F.col("path").alias("file_path"), text.alias("text")).where(F.col("document_name").rlike(wanted) & ~F.col("document_name").startswith("."))
    rows = not_blank(rows).orderBy("document_name")
    if rows.isEmpty():
        raise EmptyInput(f"no text in {path}")
    return rows


def samples(spark: SparkSession, path: str) -> DataFrame:
    return directory(spark, path, ["txt"])


def not_blank(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows whose text has more than white space."""
    return rows.where(F.coalesce(trim(F.col(column)), F.lit("")) != "")


def inline_and_files(inline: DataFrame, files: DataFrame, column: str = "text") -> DataFrame:
    """origin (0 inline, 1 file), pos and text, trimmed, inline texts first; blank ones are left out."""
    both = inline.select(F.lit(0).cast("long").alias("origin"), "pos", trim(F.col(column)).alias(column)).unionByName(files.select(F.lit(1).cast("long").alias("origin"), "pos", trim(F.col(column)).alias(column)))
    return not_blank(both, column)


def ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """doc_id of each line that is an integer after trimming."""
    return lines.select(F.expr(f"try_cast(trim({column}) as bigint)").alias("doc_id")).where(F.expr(f"trim({column}) rlike '^[+-]?[0-9]+$'") & F.col("doc_id").isNotNull())


def ids_file(spark: SparkSession, path: str) -> DataFrame:
    return ids(spark.read.text(path))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """json of a catalogue file as one row; a missing file gives none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "json string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
