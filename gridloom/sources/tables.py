"""Tables, keep-lists, split documents and reports on any file system that Spark reaches."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import key
from ..operators.relational import first_rows, require_unique

SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def scan(spark: SparkSession, path: str, id_col: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table by its suffix, CSV if it has none that is known. Ids are text; without a schema, CSV columns are read as text and numbers cast where all values are numbers."""
    kind = next((f for s, f in SUFFIXES.items() if path.rstrip("/").lower().endswith(s)), "csv")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    df = reader.schema(schema).load(path) if schema else reader.load(path)
    if kind == "csv" and schema is None:
        others = [c for c in df.columns if c != id_col]
        if others:
            bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in others)).first().asDict()
            df = df.withColumns({c: F.col(c).cast("double") for c in others if not bad[c]})
    return df.withColumn(id_col, F.col(id_col).cast("string")) if id_col in df.columns else df


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int | None = None, kind: str = "parquet") -> None:
    """Replace a table as a whole: it is written beside the old one, which stays until the new one is complete and takes its name."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.{mark}.new", f"{path.rstrip('/')}.{mark}.old"
    (df.coalesce(files) if files else df).write.format(kind).partitionBy(*partition_by).save(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        fs.delete(at(fresh), True)
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(at(fresh), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} can't be replaced")
    if there:
        fs.delete(at(old), True)


def features(spark: SparkSession, path: str, id_col: str = "case_id") -> DataFrame:
    """A feature table whose trimmed keys must be there and unique."""
    df = scan(spark, path, id_col)
    if id_col not in df.columns:
        raise ValueError(f"no column {id_col}")
    return require_unique(df.withColumn(id_col, F.trim(id_col)), [id_col])


def labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The id and label columns of a table whose headers may have blanks and any case; ids cleaned, the first row of each kept."""
    by = {c.strip().lower(): c for c in df.columns}
    id_col, *others = columns
    placed = df.select(key(F.col(by[id_col.lower()])).alias(id_col), *(F.col(by[c.lower()]).alias(c) for c in others), F.monotonically_increasing_id().alias("_place"))
    return first_rows(placed.filter(F.col(id_col).isNotNull()), [id_col], [F.col("_place")]).drop("_place")


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or one without rows where it is missing or not readable."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


MANIFEST = "number long, version string, sheets array<string>"


def current_sheets(spark: SparkSession, path: str) -> tuple[int, str, list[str]]:
    """(number, version, names) of the last set of sheets that was published as a whole; number 0 without any."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(F.desc("number"), "version").limit(1).collect()
    except AnalysisException:
        rows = []
    return (rows[0]["number"], rows[0]["version"], rows[0]["sheets"]) if rows else (0, "", [])


def write_sheets(path: str, sheets: Mapping[str, DataFrame], places: int | None = None) -> None:
    """Publish several tables as one unit: each into a new version's folder, and a line of the manifest last.

    Until that line is there, readers see the version before, whatever was written. Names are
    cut to 31 characters as in a workbook; places rounds doubles and floats.
    """
    named = {name[:31]: df for name, df in sheets.items()}
    if len(named) < len(sheets):
        raise ValueError("sheet names are the same in their first 31 characters")
    version, spark = uuid.uuid4().hex, next(iter(sheets.values())).sparkSession
    for name, df in named.items():
        inexact = [f.name for f in df.schema if f.dataType in (T.DoubleType(), T.FloatType())] if places is not None else []
        df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in inexact}).write.parquet(f"{path}/v-{version}/{name}")
    number = current_sheets(spark, path)[0] + 1
    spark.createDataFrame([(number, version, list(named))], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_sheet(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """A sheet of the last set that was published as a whole, without rows where it has none of that name."""
    _, version, names = current_sheets(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v-{version}/{name[:31]}") if name[:31] in names else spark.createDataFrame([], schema)


def first_layout(spark: SparkSession, paths: Sequence[str], schema: T.StructType, renamed: Mapping[str, str]) -> DataFrame:
    """The first of several layouts that has rows, older column names changed."""
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            continue
        if not df.isEmpty():
            return df.withColumnsRenamed(dict(renamed))
    return spark.createDataFrame([], schema)


SPLITS = T.StructType([
    T.StructField("outer_fold", T.IntegerType()), T.StructField("train_case_ids", T.ArrayType(T.StringType())), T.StructField("test_case_ids", T.ArrayType(T.StringType())),
    T.StructField("inner_splits", T.ArrayType(T.StructType([
        T.StructField("inner_fold", T.IntegerType()), T.StructField("train_case_ids", T.ArrayType(T.StringType())), T.StructField("val_case_ids", T.ArrayType(T.StringType())),
    ]))),
])


def split_table(documents: DataFrame) -> DataFrame:
    """(outer_fold, inner_fold, case_id, role) of split documents; inner_fold is null for the outer train and test roles."""
    outer = [documents.select("outer_fold", F.lit(None).cast("int").alias("inner_fold"), F.explode(f"{r}_case_ids").alias("case_id"), F.lit(r).alias("role")) for r in ("train", "test")]
    inner = documents.select("outer_fold", F.explode("inner_splits").alias("s"))
    parts = [inner.select("outer_fold", "s.inner_fold", F.explode(f"s.{r}_case_ids").alias("case_id"), F.lit(f"inner_{r}").alias("role")) for r in ("train", "val")]
    return outer[0].unionByName(outer[1]).unionByName(parts[0]).unionByName(parts[1])


def split_documents(nested: DataFrame, own: DataFrame, key_col: str) -> DataFrame:
    """Split documents from (key, outer_fold, inner_fold) of training keys and (key, outer_fold) of held-out ones."""
    ids = lambda c: F.array_sort(F.collect_list(c.cast("string")))
    k = F.col(key_col)
    inner = nested.select("outer_fold", "inner_fold").distinct()
    per = nested.withColumnRenamed("inner_fold", "_own").join(inner, "outer_fold").groupBy("outer_fold", "inner_fold")
    sides = per.agg(ids(F.when(F.col("_own") != F.col("inner_fold"), k)).alias("train_case_ids"), ids(F.when(F.col("_own") == F.col("inner_fold"), k)).alias("val_case_ids"))
    packed = sides.groupBy("outer_fold").agg(F.array_sort(F.collect_list(F.struct("inner_fold", "train_case_ids", "val_case_ids"))).alias("inner_splits"))
    train = nested.groupBy("outer_fold").agg(ids(k).alias("train_case_ids"))
    test = own.groupBy("outer_fold").agg(ids(k).alias("test_case_ids"))
    return train.join(test, "outer_fold").join(packed, "outer_fold").select(*SPLITS.names)


def write_splits(documents: DataFrame, path: str) -> None:
    publish(documents, path, kind="json")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLITS).json(path)


def read_or_build_splits(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored split documents; where there are none, those of ``build()``, stored first."""
    try:
        found = read_splits(spark, path)
        if not found.isEmpty():
            return found
    except AnalysisException:
        pass
    write_splits(build(), path)
    return read_splits(spark, path)


def keep_list(spark: SparkSession, path: str) -> DataFrame:
    """(block, feature) of a JSON document of lists by block."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("block", "_f")).select("block", F.explode("_f").alias("feature"))


def write_sorted(df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str]) -> None:
    """One sorted CSV file of those wanted columns that exist."""
    there = [c for c in columns if c in df.columns]
    df.select(*there).orderBy(*(k for k in keys if k in there)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_lines(df: DataFrame, title: str, measures: Sequence[str], ties: Sequence[str], n: int = 10) -> DataFrame:
    """(line, text): a title and the n best rows, for a text sink."""
    best = df.orderBy(*(F.col(m).desc_nulls_last() for m in measures), *ties).limit(n)
    place = F.row_number().over(Window.orderBy(*(F.col(m).desc_nulls_last() for m in measures), *ties))
    body = best.select(place.alias("line"), F.concat_ws("  ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in (*ties, *measures))).alias("text"))
    return df.sparkSession.createDataFrame([(0, title)], "line int, text string").unionByName(body)


def geometry_report(geometry: DataFrame, case: str, measures: Sequence[str]) -> DataFrame:
    """Cases with their geometry, led by a row of averages that leaves nulls out."""
    average = geometry.agg(*(F.avg(m).alias(m) for m in measures)).select(F.lit("AVERAGE").alias(case), *measures)
    return average.unionByName(geometry.select(F.col(case).cast("string").alias(case), *(F.col(m).cast("double").alias(m) for m in measures)))


def discover(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """(case_id, path): files below a folder by stem; of several files of a case, that whose suffix comes first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    pattern = "(?:" + "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True)) + ")$"
    suffix = F.regexp_extract(name, pattern, 0)
    found = files.withColumn("_suffix", suffix).filter("_suffix <> ''").withColumn("case_id", F.regexp_replace(name, pattern, ""))
    order = F.array_position(F.array(*(F.lit(s) for s in suffixes)), F.col("_suffix"))
    return first_rows(found, ["case_id"], [order, F.col("path")]).select("case_id", "path")
