"""Where sources are read from: files, directories with a glob, URLs, text at hand."""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession

from sparkloom.runtime import shared_path


def directory(spark: SparkSession, root: str, pattern: str = "*", max_depth: int = 20) -> list[str]:
    """Files below ``root``, in any file system Spark knows, whose path matches the glob, in order of their path.

    In the glob ``*`` and ``?`` stay within a folder's name, ``**`` crosses folders, ``{a,b}`` are alternatives; a pattern without
    a stroke is matched with the file's name.
    """
    matches = re.compile(glob_expression(pattern)).fullmatch
    top = spark._jvm.org.apache.hadoop.fs.Path(root)  # noqa: SLF001
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    found, folders = [], [(top, root.rstrip("/"), 0)]
    while folders:
        folder, path, depth = folders.pop()
        for status in system.listStatus(folder):
            name = f"{path}/{status.getPath().getName()}"
            if not status.isDirectory():
                found += [name] * bool(matches(name if "/" in pattern else status.getPath().getName()))
            elif depth < max_depth:
                folders.append((status.getPath(), name, depth + 1))
    return sorted(found)


def glob_expression(pattern: str) -> str:
    """A glob as a regular expression."""
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    out, within = [], 0
    for sign in re.findall(r"\*\*/|\*\*|.", pattern, re.DOTALL):
        within += (sign == "{") - (sign == "}")
        out.append(signs[sign] if sign in signs and (sign != "," or within) else re.escape(sign))
    return "".join(out)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file in any file system Spark knows."""
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)  # noqa: SLF001
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def fetched(spark: SparkSession, url: str) -> str:
    """A URL's content as a file in the shared folder."""
    with urllib.request.urlopen(url) as source:
        return _stored(spark, iter(lambda: source.read(1 << 20), b""))


def written(spark: SparkSession, content: str | bytes) -> str:
    """Text at hand as a file in the shared folder."""
    return _stored(spark, iter([content.encode() if isinstance(content, str) else content]))


def _stored(spark: SparkSession, chunks: Iterator[bytes]) -> str:
    path = shared_path(spark, "source")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)  # noqa: SLF001
    try:
        for chunk in chunks:
            target.write(bytearray(chunk))
    finally:
        target.close()
    return path


def as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)
