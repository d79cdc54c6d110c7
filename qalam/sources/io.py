"""Corpus readers and writers.

Formats are chosen from the path suffix; JSON files holding one array are
read with ``multiLine``. Splits and dialect folders are written with
``partitionBy`` so each lands in its own directory in one job.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .digests import file_digests

FORMATS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".txt": "text"}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def detect_format(path: str) -> str:
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "json")


def read_corpus(spark: SparkSession, path: str, fmt: str = "auto", schema=None, json_array: bool = False,
                multiline_csv: bool = False) -> DataFrame:
    """A1/A2: read json/jsonl/csv/tsv/parquet/text; unknown suffix -> json.
    A missing path raises FileNotFoundError; an unknown format ValueError.
    ``json_array``: each file holds one array (else a record a line);
    ``multiline_csv``: quoted fields hold line breaks. Either makes a file
    one task, so both are the caller's to say."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Dataset path not found: {path}")
    if fmt == "auto":
        fmt = detect_format(path)
    r = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "json":
        return r.option("multiLine", json_array).json(path)
    if fmt == "csv":
        sep = "\t" if path.lower().endswith(".tsv") else ","
        return r.option("header", True).option("sep", sep).option("multiLine", multiline_csv).option("escape", '"').csv(path)
    if fmt == "tsv":
        return r.option("header", True).option("sep", "\t").csv(path)
    if fmt == "parquet":
        return r.parquet(path)
    if fmt == "text":
        return r.text(path)
    raise ValueError(f"Unsupported data format: {fmt}")


def read_with_validation(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """A3: the file plus its sibling ``<stem>_val<ext>`` as the validation
    split (a missing sibling only means no validation rows)."""
    train = read_corpus(spark, path, fmt).withColumn("split", F.lit("train"))
    stem, ext = os.path.splitext(path)
    val = f"{stem}_val{ext}"
    if exists(spark, val):
        return train.unionByName(read_corpus(spark, val, fmt).withColumn("split", F.lit("validation")),
                                 allowMissingColumns=True)
    return train


def write_corpus(df: DataFrame, path: str, fmt: str = "json", split_col: str | None = None, mode: str = "overwrite") -> None:
    """A4/A5: json/csv/parquet; ``split_col`` (split or dialect) becomes one
    folder per value via ``partitionBy``."""
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode(mode)
    if split_col:
        w = w.partitionBy(split_col)
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)


def write_with_manifest(df: DataFrame, path: str, fmt: str = "parquet", split_col: str | None = None, **flags) -> dict:
    """Write, then a one-row JSON manifest (size, columns, format,
    created_at, flags) next to the data; size is one aggregate."""
    write_corpus(df, path, fmt, split_col)
    spark = df.sparkSession
    n = spark.read.format(fmt).load(path).count() if fmt != "csv" else spark.read.option("header", True).csv(path).count()
    manifest = {"size": n, "columns": df.columns, "format": fmt, "flags": flags,
                "created_at": spark.range(1).select(F.current_timestamp().cast("string")).first()[0]}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "manifest string") \
        .coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_manifest")
    return manifest


def read_with_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Load data written by ``write_with_manifest``; its columns and its
    row count must be the manifest's."""
    m = spark.read.json(path.rstrip("/") + "_manifest").collect()[0]
    manifest = json.loads(m["manifest"])
    df = spark.read.format(manifest["format"]).load(path)
    missing = set(manifest["columns"]) - set(df.columns)
    if missing:
        raise ValueError(f"manifest columns missing from data: {sorted(missing)}")
    if (n := df.count()) != manifest["size"]:
        raise ValueError(f"manifest has {manifest['size']} rows, the data {n}")
    return df, manifest


def combine(frames: dict[str, DataFrame]) -> DataFrame:
    """Tag each source with ``source_dataset`` and union by name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn("source_dataset", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """A10: per set: row count, column list and the first row (the least by its
    columns in order) as JSON; one aggregate per set, unioned."""
    out = None
    for name, df in frames.items():
        first = F.to_json(F.min(F.struct(*df.columns)))
        t = df.agg(F.count(F.lit(1)).alias("num_rows"), first.alias("first_row")) \
            .select(F.lit(name).alias("dataset"), "num_rows", F.lit(",".join(df.columns)).alias("columns"), "first_row")
        out = t if out is None else out.unionByName(t)
    return out


def report_lines(long_report: DataFrame, section_col: str = "section", key_col: str = "metric",
                 value_col: str = "value") -> DataFrame:
    """Long metric table -> markdown lines ordered by section and key."""
    return long_report.select(section_col, key_col, F.concat(F.lit("- **"), F.col(key_col), F.lit("**: "),
                                                            F.col(value_col).cast("string")).alias("line")) \
        .orderBy(section_col, key_col)


_LINES = "array<struct<place:string,line:string>>"


def _line(place: Column, text: Column) -> Column:
    return F.struct(place.alias("place"), text.alias("line"))


def _section(name: Column, value: Column, kind, depth: int, place: Column) -> Column:
    """The lines of one section, of a struct or a map: heading, entries in order, empty line; a missing one has no entries."""
    heading = F.array(_line(F.concat(place, F.lit("/")), F.concat(F.lit("#" * (depth + 1) + " "), name)))
    end = F.array(_line(F.concat(place, F.lit("/~")), F.lit("")))

    def entry(key: Column, item: Column, of, at: Column) -> Column:
        here = F.concat(place, F.lit("/"), at)
        if of.typeName() in ("struct", "map"):
            return _section(key, item, of, depth + 1, here)
        shown = F.concat(F.lit("["), F.array_join(item.cast("array<string>"), ", ", "null"), F.lit("]")) \
            if of.typeName() == "array" else item.cast("string")
        return F.array(_line(here, F.concat(F.lit("- **"), key, F.lit("**: "), F.coalesce(shown, F.lit("null")))))

    if kind.typeName() == "struct":
        parts = [entry(F.lit(f.name), value[f.name], f.dataType, F.lit(f"{i:06d}")) for i, f in enumerate(kind.fields)]
        inner = F.concat(*parts) if parts else F.array().cast(_LINES)
    else:
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))),
                             lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        inner = F.flatten(F.transform(pairs, lambda e, i: entry(e["key"], e["value"], kind.valueType, F.lpad(i.cast("string"), 6, "0"))))
    return F.concat(heading, F.coalesce(inner, F.array().cast(_LINES)), end)


def nested_report_lines(report: DataFrame, title: str = "Dataset Analysis") -> DataFrame:
    """A nested report, one row of structs, maps and values, as markdown lines ``(place, line)``.

    The schema says what is a section (structs; maps by key) and what a line;
    ``place`` sorts the lines: the entries' numbers along the path. Several
    rows give several reports, told apart by a leading row number.
    """
    from pyspark.sql.types import StructType
    kind: StructType = report.schema
    row = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    found = report.select(row.alias("__row"), F.struct(*report.columns).alias("__r"))
    lines = _section(F.lit(title), F.col("__r"), kind, 1, F.col("__row"))
    return found.select(F.explode(lines).alias("__l")).select("__l.place", "__l.line")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in order: dealt by ranges of their place, so part files follow one another."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


#: Files beyond this size are dealt one a task.
CELL_BYTES = 1 << 30


def file_hashes(spark: SparkSession, path: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Length and md5 / sha1 / sha256 of each file's bytes.

    The binaryFile source lists the files; their bytes never become a cell
    but go block by block into the digests. Files up to ``cell_bytes`` share
    tasks as that source deals them, each larger one has a task of its own:
    a digest is sequential by its nature.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [(r.path, r.length) for r in files.filter(F.col("length") > cell_bytes).collect()]
    names = files.filter(F.col("length") <= cell_bytes)
    if large:
        # a slice a file: hashes of the names would put several files into one task
        names = names.unionByName(spark.createDataFrame(spark.sparkContext.parallelize(large, len(large)), files.schema))
    found = names.withColumn("__d", file_digests(spark, "path"))
    if any(spark.conf.get(f"spark.sql.files.ignore{kind}Files") == "true" for kind in ("Missing", "Corrupt")):
        found = found.filter("__d IS NOT NULL")  # only then, as a filter would make a mere count read the files
    return found.select("path", "length", "__d.*")


def cached_processed(df_fn, spark: SparkSession, cache_root: str, source: str, config: dict) -> DataFrame:
    """Processed-data cache keyed by sha256(source + config); the
    cached parquet is reused when present, else computed and written."""
    import hashlib
    key = hashlib.sha256((source + json.dumps(config, sort_keys=True)).encode()).hexdigest()[:16]
    path = f"{cache_root.rstrip('/')}/{key}"
    if exists(spark, path + "/_SUCCESS"):
        return spark.read.parquet(path)
    df_fn().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
