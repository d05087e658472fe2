"""Files and folders by Hadoop's own interface, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _at(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names within a folder, sorted; none if there is no such folder."""
    place, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and length of each file of a folder, in order of names; folders within it are left out."""
    place, files = _at(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    return sorted((s.getPath().getName(), s.getLen()) for s in found if s.isFile())


def delete(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over one that is there."""
    place, files = _at(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    place, files = _at(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file, over one that is there where the store can."""
    place, files = _at(spark, old)
    target = _at(spark, new)[0]
    if not files.rename(place, target):
        files.delete(target, False)
        if not files.rename(place, target):
            raise OSError(f"{old} could not be renamed to {new}")
