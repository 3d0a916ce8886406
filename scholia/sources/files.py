"""Other scans and sinks: validated JSON lines, CSV without identity columns, JSON in ZIP files, manifests."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of field names that show a person's identity.
IDENTITY = ("name", "email", "orcid", "author")


def assert_no_identity(schema: T.StructType, path: str = "") -> None:
    """Refuse a schema with a field, at any depth, whose name shows a person's identity."""
    for f in schema.fields:
        words = re.split(r"[^a-z]+", f.name.lower())
        if any(w in IDENTITY for w in words):
            raise ValueError(f"field {path}{f.name} may identify a person")
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            assert_no_identity(kind, f"{path}{f.name}.")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, faults): blank lines are skipped; a line that is no JSON, or has a key the schema lacks, is a fault with its file."""
    assert_no_identity(schema)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    own = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    r = lines.withColumn("r", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    keys = F.json_object_keys("value")
    extra = F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]))
    fault = F.when(keys.isNull() | F.col("r._corrupt").isNotNull(), "not valid").when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ",")))
    r = r.withColumn("fault", fault)
    return r.where("fault IS NULL").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields]), r.where("fault IS NOT NULL").select("file", "value", "fault")


def csv_table(spark: SparkSession, path: str, required: list[str], dropped: list[str]) -> DataFrame:
    """A CSV file with header, all columns as text, a byte order mark removed; the required columns are checked, the dropped never read on."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.drop(*dropped)


def members_of(contents: pd.Series, pattern: str) -> pd.DataFrame:
    """(member, content) of the members of ZIP files, given as bytes, whose names match."""
    rows = []
    for content in contents:
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            rows += [(m, z.read(m).decode("utf-8", "replace")) for m in sorted(z.namelist()) if re.search(pattern, m)]
    return pd.DataFrame(rows, columns=["member", "content"])


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, member, content) of the members of ZIP files whose names match; a ZIP is read by one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                found = members_of(pd.Series([content]), pattern)
                yield found.assign(file=file)[["file", "member", "content"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, content string")


def decoded_text(content: bytes) -> str:
    """Text of bytes by their byte order mark, else UTF-8, else CP949, else Latin-1; line ends as LF."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace").replace("\r\n", "\n").replace("\r", "\n")
    for name in ("utf-8", "cp949", "latin-1"):
        try:
            return content.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole text files in whatever encoding."""
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: decoded_text(bytes(b)))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decode("content").alias("text"))


def _hashed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, bytes, sha256) of a folder's files, hashed by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_with_manifest(df: DataFrame, folder: str, keys: list[str], partitions: int | None = None, kind: str = "parquet") -> dict:
    """Parquet or JSON lines sorted by key within files, and a manifest, written last, with the rows and each file's size and hash.

    The manifest is a row of JSON text in the folder's ``_manifest``; readers of
    the data pass over it. A folder without one was not written to its end.
    """
    out = df.repartitionByRange(partitions, *keys) if partitions else df
    out.sortWithinPartitions(*keys).write.mode("overwrite").format(kind).save(folder)
    spark = df.sparkSession
    files = [r.asDict() for r in _hashed(spark, folder, f"*.{kind}").orderBy("file").collect()]  # a row per file
    manifest = {"rows": spark.read.format(kind).schema(df.schema).load(folder).count(), "columns": df.columns, "files": files}
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")
    return manifest


def read_checked(spark: SparkSession, folder: str, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A folder written with a manifest; refused where a file is missing or its hash differs."""
    manifest = json.loads(spark.read.text(f"{folder}/_manifest").first()[0])
    try:
        held = {r["file"]: r["sha256"] for r in _hashed(spark, folder, f"*.{kind}").collect()}
    except (Py4JJavaError, PySparkException) as e:  # a file system with checksums of its own may refuse first
        raise ValueError(f"a file of {folder} cannot be read") from e
    for x in manifest["files"]:
        if held.get(x["file"]) != x["sha256"]:
            raise ValueError(f"{x['file']} is not the file of the manifest")
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(folder)


def csv_safe(c: Column | str) -> Column:
    """Text that a spreadsheet takes for a formula gets a quote in front."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
