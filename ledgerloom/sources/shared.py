"""Folders that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Files or folders of one listing: of more, the driver holds no more than their names.
LISTED = 30_000


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the session's `spark.checkpoint.dir`, which must be a folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def with_local_folder(spark: SparkSession) -> SparkSession:
    """For sessions on one machine only: name a temporary folder if none is set. Elsewhere nothing is changed."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark


def stage(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Write the rows to a shared folder and read them back.

    For results that several later steps read: they are computed once, and a lost executor costs a re-read
    of its files rather than the whole lineage.
    """
    path = folder or shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The pattern, once for each folder that its wildcards above the last level stand for and that holds a match."""
    return [own for own in _by_folder(spark, pattern) if _count(spark, own, inside=False)] or [pattern]


def _by_folder(spark: SparkSession, pattern: str) -> list[str]:
    levels = pattern.split("/")
    first = next((at for at, level in enumerate(levels[:-1]) if re.search(r"[*?\[]", level)), None)
    if first is None or re.search(r"[{\\]", pattern):
        return [pattern]
    rest = "/".join(levels[first + 1 :])
    found = [name for names in _names(spark, "/".join(levels[: first + 1])) for name in names]
    # A name with signs of its own that mean something in a pattern is left to the whole pattern.
    if any(literal(name) != name for name in found):
        return [pattern]
    return [own for name in sorted(found) for own in _by_folder(spark, f"{name}/{rest}")]


def in_parts(spark: SparkSession, paths: Iterable[str], most: int | None = None) -> Iterator[list[str]]:
    """The paths in groups that stand for up to `most` (LISTED) files or folders each.

    Patterns go folder by folder, and what stands for more than `most` is named one by one. A path that is not there
    stays, for the reader to complain of.
    """
    most = most or LISTED
    group, held = [], 0
    for path in paths:
        for pattern in folders(spark, path):
            count = _count(spark, pattern)
            if count <= most:
                if group and held + count > most:
                    yield group
                    group, held = [], 0
                group.append(pattern)
                held += count
                continue
            inside = pattern if _count(spark, pattern, inside=False) > 1 else f"{pattern.rstrip('/')}/*"
            for names in _names(spark, inside, most):
                # Readers pass over some files by their names.
                yield [literal(name) for name in names if not re.search(r"/[_.][^/=]*$", name)]
    if group:
        yield group


def literal(name: str) -> str:
    """A pattern that stands for this name alone."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", name)


def _found(spark: SparkSession, pattern: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.globStatus(path) or []


def _count(spark: SparkSession, pattern: str, inside: bool = True) -> int:
    """How many files or folders a pattern stands for; `inside` looks into it if that is one folder."""
    files, found = _found(spark, pattern)
    if inside and len(found) == 1 and found[0].isDirectory():
        return len(files.listStatus(found[0].getPath()))
    return len(found)


def _names(spark: SparkSession, pattern: str, most: int | None = None) -> Iterator[list[str]]:
    """The names that a pattern stands for, so many at a time."""
    jvm, most = spark.sparkContext._jvm, most or LISTED
    _, found = _found(spark, pattern)
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found) if found else []
    for start in range(0, len(paths), most):
        size = min(most, len(paths) - start)
        part = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, size)
        jvm.java.lang.System.arraycopy(paths, start, part, 0, size)
        yield jvm.org.apache.commons.lang3.StringUtils.join(part, "\0").split("\0")
