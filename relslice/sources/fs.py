"""Small files and renames through the cluster's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the name of a small file's next version ends in until it has taken the old one's place.
_NEXT = ".__new"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listdir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Data files at any depth below a folder, relative to it; names that begin with _ or . are not data."""
    fs, p = _path(spark, path)
    found, base = [], f"{fs.makeQualified(p)}/"
    if fs.exists(p):
        there = fs.listFiles(p, True)
        while there.hasNext():
            name = there.next().getPath().toString().removeprefix(base)
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found.append(name)
    return sorted(found)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, a file, or a small file written by :func:`write_text`."""
    for name in (f"{path}{_NEXT}", path):
        fs, p = _path(spark, name)
        fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move ``old`` to ``new``, which must not exist."""
    fs, p = _path(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(p, target):
        raise OSError(f"cannot move {old} to {new}")


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put ``new`` where ``old`` is; the old one is kept aside until the new one is in place."""
    aside = f"{old}.__old"
    delete(spark, aside)
    if exists(spark, old):
        rename(spark, old, aside)
    rename(spark, new, old)
    delete(spark, aside)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole; at every moment either the old or the new text can be read.

    File systems differ in whether a rename replaces its target, so the new text gets a name of its own first: once
    it has it, it counts where the old file is gone.
    """
    fs, draft = _path(spark, f"{path}.__tmp")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    following, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}{_NEXT}", path))
    if not fs.exists(target):
        _move(fs, following, target)  # of a write that ended between its steps
    fs.delete(following, False)
    for old, new in ((draft, following), (following, target)):
        if new is target:
            fs.delete(target, False)
        if not fs.rename(old, new):
            raise OSError(f"cannot write {path}")


def _move(fs, old, new) -> None:
    if fs.exists(old):
        fs.rename(old, new)


def has_text(spark: SparkSession, path: str) -> bool:
    """Whether a small file is there."""
    return exists(spark, path) or exists(spark, f"{path}{_NEXT}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{_NEXT}")
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
