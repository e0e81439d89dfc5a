"""Reports written so that a retry leaves one complete version.

A version is written to a folder of its own; then a manifest that names it takes the
place of the last one in a single rename. Readers follow the manifest, so they see
the old version or the new one, whole, whenever a write is killed or repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "current.json"


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, type]:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the last complete write says of itself; None before the first."""
    files, place = _files(spark, path)
    if not files.exists(place(f"{path}/{MANIFEST}")):
        return None
    text = "\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect())     # one small file
    return json.loads(text)


def write_version(df: DataFrame, path: str, file_format: str = "parquet", version: str | None = None) -> str:
    """Write the frame as the current version of the report and return its name. A
    repeated write under the same ``version`` starts that version anew."""
    spark = df.sparkSession
    version = version or uuid.uuid4().hex
    df.write.mode("overwrite").option("header", True).format(file_format).save(f"{path}/v-{version}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = spark.read.schema(schema).option("header", True).format(file_format).load(f"{path}/v-{version}").count()
    text = json.dumps({"version": version, "format": file_format, "schema": schema, "rows": rows})
    files, place = _files(spark, path)
    staged = place(f"{path}/_staged-{uuid.uuid4().hex}.json")
    out = files.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(spark, files, staged, place(f"{path}/{MANIFEST}"))
    return version


def _replace(spark: SparkSession, files: JavaObject, staged: JavaObject, target: JavaObject) -> None:
    """Rename over the target in one step."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, target, options)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a report."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no complete version")
    reader = spark.read.schema(found["schema"]).option("header", True).format(found["format"])
    return reader.load(f"{path}/v-{found['version']}")


def write_parts(df: DataFrame, path: str, parts: Sequence[str], file_format: str = "parquet") -> None:
    """Replace only the partitions that the frame has rows of, others stay. Files are
    staged and moved when all tasks have ended, so a retry leaves each partition
    once."""
    df.repartition(*parts, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*parts).format(file_format).save(path)
