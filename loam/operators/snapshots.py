"""Tables that are replaced as a whole while others read them: a folder for each version, and a small file that names the current one."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published a version since this one began."""


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    at, fs = _place(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, path: str, commit: str) -> dict:
    return json.loads(spark.read.text(f"{path}/commits/{commit}", wholetext=True).first()[0])


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last published version; null before the first."""
    commits = _commits(spark, path)
    return f"{path}/{_read(spark, path, commits[-1])['folder']}" if commits else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let write() fill a new folder, then make it the current version in one step; gives the folder.

    Readers see the old version or the whole new one: what they read is named by the last of the numbered files in
    commits/, and such a file is created, never changed. Of writers at the same time the first to finish wins, the others get Conflict and
    leave nothing behind. A write that fails leaves the old version. The last `keep` versions stay for readers that
    have begun; older ones, and their files in commits/, are deleted.
    """
    before = _commits(spark, path)
    number = int(before[-1].split(".")[0]) + 1 if before else 0
    folder = f"versions/{number:012d}-{uuid.uuid4().hex}"
    at, fs = _place(spark, f"{path}/{folder}")
    try:
        write(f"{path}/{folder}")
        commit, _ = _place(spark, f"{path}/commits/{number:012d}.json")
        hidden, _ = _place(spark, f"{path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(json.dumps({"folder": folder}).encode()))
        finally:
            out.close()
        if fs.exists(commit) or not _rename(fs, hidden, commit):
            fs.delete(hidden, False)
            raise Conflict(f"version {number} of {path} was published by another writer")
    except BaseException:
        with contextlib.suppress(Py4JJavaError):
            fs.delete(at, True)
        raise
    collect_garbage(spark, path, keep)
    return f"{path}/{folder}"


def _rename(fs, source, target) -> bool:
    try:
        return bool(fs.rename(source, target))
    except Py4JJavaError:  # file systems that fail where the target is there
        return False


def collect_garbage(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions but the last `keep` and those that are being written (numbered after the last); gives the folders that went."""
    commits = _commits(spark, path)
    if not commits:
        return []
    old, kept = commits[: -max(1, keep)], {_read(spark, path, c)["folder"].split("/")[1] for c in commits[-max(1, keep) :]}
    at, fs = _place(spark, f"{path}/versions")
    gone = []
    for c in old:
        fs.delete(_place(spark, f"{path}/commits/{c}")[0], False)
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name not in kept and int(name.split("-")[0]) <= int(commits[-1].split(".")[0]):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
