"""Files wherever the cluster keeps them: listing, whole small files, hashes. Paths are local paths or URIs."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str | Path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str | Path) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def is_folder(spark: SparkSession, path: str | Path) -> bool:
    place, files = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def listed(spark: SparkSession, pattern: str | Path) -> list[str]:
    """Files that match a glob pattern, sorted."""
    place, files = _place(spark, pattern)
    return sorted(_files(spark, files.globStatus(place)))


def _files(spark: SparkSession, found) -> list[str]:
    """Paths of those statuses that are files, in two texts: one call a file takes longer than the listing."""
    if not found:
        return []
    tools = spark.sparkContext._jvm.org.apache.commons.collections4
    every = tools.IteratorUtils.toList(tools.IteratorUtils.getIterator(found))
    of = lambda name: joined(spark, tools.CollectionUtils.collect(every, tools.functors.InvokerTransformer.invokerTransformer(name)))
    return [p for p, k in zip(of("getPath"), of("isFile"), strict=True) if k == "true"]


def joined(spark: SparkSession, values) -> list[str]:
    """A Java array or collection as texts, fetched in one call."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.commons.lang3.StringUtils.join(jvm.org.apache.commons.collections4.IteratorUtils.getIterator(values), "\0").split("\0") if len(values) else []


def below(spark: SparkSession, folder: str | Path, suffix: str) -> list[str]:
    """Files at any depth under a folder whose names end with ``suffix``, sorted; names that begin with ``_`` or ``.`` don't count."""
    place, files = _place(spark, folder)
    found, each = [], files.listFiles(place, True)
    while each.hasNext():
        path = each.next().getPath()
        if path.getName().endswith(suffix) and path.getName()[0] not in "_.":
            found.append(path.toString())
    return sorted(found)


def make(spark: SparkSession, folder: str | Path) -> None:
    place, files = _place(spark, folder)
    files.mkdirs(place)


def move(spark: SparkSession, path: str, target: str) -> None:
    """A file under another name, where there is none yet."""
    place, files = _place(spark, path)
    fresh, _ = _place(spark, target)
    if files.exists(fresh) or not files.rename(place, fresh):
        raise FileExistsError(f"{path} can't become {target}")


def local_path(spark: SparkSession, path: str | Path) -> str | None:
    """The path in the machines' own file system, None for any other storage."""
    place, files = _place(spark, path)
    return files.makeQualified(place).toUri().getPath() if files.getScheme() == "file" else None


def read_text(spark: SparkSession, path: str | Path) -> str:
    """A small file whole."""
    place, files = _place(spark, path)
    source = files.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8-sig")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str | Path, content: str) -> None:
    """A small file that appears whole or not at all, in place of an older one."""
    place, files = _place(spark, path)
    files.mkdirs(place.getParent())
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = files.create(fresh)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(place).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(place), options)


def content_digest(spark: SparkSession, paths: list[str], names: bool = True) -> str:
    """SHA-256 over the files' bytes in the order of their paths, each behind its name. Bytes never come to Python."""
    jvm = spark.sparkContext._jvm
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    for path in sorted(paths):
        place, files = _place(spark, path)
        if names:
            sink.write(bytearray(place.getName().encode()))
        source = files.open(place)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, 1 << 20, False)
        finally:
            source.close()
    return bytes(x & 0xFF for x in digest.digest()).hex()
