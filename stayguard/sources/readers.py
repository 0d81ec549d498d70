"""Input readers.

CSV files are read with a header and *no* schema: every column is STRING and
the names come from the file (typing happens later with ``try_cast``). Spark
binds a given schema by position and applies one header to a whole directory,
so files are grouped by their header line and each group is read on its own,
then the groups are unioned by name. Only files with line ends inside quotes are read whole
by one task each; all others are split.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_header(spark: SparkSession, path: str) -> str:
    """Header line of one CSV file through the cluster's Hadoop file system: only the file's first
    block is opened, no Spark job runs. A file that cannot be opened is an error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").lstrip("\ufeff").rstrip("\r")


def csv_headers(spark: SparkSession, paths: list[str]) -> list[str]:
    """Headers of many files, opened side by side (the driver only waits for the storage)."""
    with ThreadPoolExecutor(max_workers=min(32, max(1, len(paths)))) as pool:
        return list(pool.map(lambda p: csv_header(spark, p), paths))


def files_with_quoted_line_ends(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which some line has an odd number of quotes: a field goes on in the next line there.

    One pass over the lines, split like any text; a doubled quote counts twice, so it changes nothing."""
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    found = spark.read.text(paths).where(odd).select(F.col("_metadata.file_path").alias("path")).distinct().collect()  # names of files
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["path"])).toUri().getPath() for r in found}

    def qualified(path: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toUri().getPath()

    return {p for p in paths if qualified(p) in whole} if whole else set()


def read_csv_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Many CSV files, possibly with different headers, as one all-STRING frame."""
    whole = files_with_quoted_line_ends(spark, paths)
    groups: dict[tuple[str, bool], list[str]] = {}
    for path, header in zip(paths, csv_headers(spark, paths)):
        groups.setdefault((header, path in whole), []).append(path)
    from ..operators.schema import resolve_columns
    frames = []
    for (_, multi), g in groups.items():
        f = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi).option("quote", '"').option("escape", '"').csv(g)
        # aliases are mapped per header group, before the union, so that every
        # group's columns land on the canonical names
        renamed = resolve_columns(f).renamed
        frames.append(f.select([_na_to_null(c).alias(renamed.get(c, c)) for c in f.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# Text cells a CSV reader of the pandas family treats as missing (its documented default
# NA tokens); Spark's CSV reader knows only one null token, so the rest are mapped here.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _na_to_null(c: str):
    col = F.col(f"`{c}`")
    return F.when(col.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records; the schema is the union of the keys seen."""
    return spark.read.json(path)


def read_split(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """S3: one split of a table written with ``partitionBy('split')`` (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_prepared(df: DataFrame, path: str) -> None:
    """Prepared table partitioned by split (so S3 reads only one folder)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
