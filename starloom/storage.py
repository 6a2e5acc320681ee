"""The folder that the cluster shares, tables written there to cut lineage, and files that appear at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import LoadError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, which only a local session may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise LoadError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="starloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, read again when executors are lost."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, p = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def text_of(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear at once and whole; False if another writer made it first.

    The file is written beside its place and renamed without overwriting, which the file
    system decides for one writer.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, draft)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    qualified = fs.makeQualified(p)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(qualified, fs.makeQualified(hadoop(spark, path)[1]), how)
    except Exception as e:
        fs.delete(p, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
