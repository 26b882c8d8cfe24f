"""Numbered texts in a folder, each published by one rename, so that a reader sees whole versions only.

The folder must lie in a file system whose rename is atomic and refuses to replace a file.
"""

import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and the constructor of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob finds, as full paths."""
    system, at = files(spark, pattern)
    return [f.getPath().toString() for f in system.globStatus(at(pattern)) or []]


def delete(spark: SparkSession, path: str) -> None:
    system, at = files(spark, path)
    system.delete(at(path), True)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """All published versions, rising."""
    return sorted(int(p.rsplit("/v", 1)[1]) for p in listed(spark, f"{folder}/v[0-9]*"))


def _name(folder: str, number: int) -> str:
    return f"{folder}/v{number:012d}"


def read(spark: SparkSession, folder: str, number: int) -> str:
    system, at = files(spark, folder)
    stream = system.open(at(_name(folder, number)))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The newest version and its text; (0, None) if there is none."""
    found = numbers(spark, folder)
    return (found[-1], read(spark, folder, found[-1])) if found else (0, None)


def publish(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Publish ``text`` as version ``number``; False if another writer was first."""
    system, at = files(spark, folder)
    draft = at(f"{folder}/_draft-{uuid.uuid4().hex}")
    system.mkdirs(at(folder))
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(at(_name(folder, number))), never_replace)
    except Exception as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def forget(spark: SparkSession, folder: str, number: int) -> None:
    delete(spark, _name(folder, number))
