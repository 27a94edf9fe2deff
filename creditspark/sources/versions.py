"""Folders that are replaced as a whole: versions behind manifests.

``<path>/<version folder>`` holds the data and ``<path>/manifest/<number>-<folder>.json`` says that it is complete. A writer fills a new
folder and writes its manifest last, by one rename; until then readers get the version before, and whoever reads that version goes on
doing so, as its files stay. A checked version lists its files with sizes and SHA-256 digests, which are compared on load.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """(Hadoop path, its file system)"""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def new_folder(spark: SparkSession, path: str) -> str:
    """An unused folder for the next version."""
    return f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, file) of all manifests, oldest first."""
    where, fs = _fs(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((int(n.split("-")[0]), f"{where}/{n}") for n in names if n.endswith(".json"))


def file_digests(spark: SparkSession, folder: str) -> list[dict]:
    """Name, size and SHA-256 of every file below a folder of small files (models, fitted tables)."""
    root, fs = _fs(spark, folder)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", base, 2), 2)
    return [r.asDict() for r in files.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("name").collect()]


def commit(spark: SparkSession, path: str, folder: str, checked: bool = False) -> None:
    """Makes ``folder`` the current version of ``path``. One writer at a time per path; of two, the later number or name wins."""
    done = _manifests(spark, path)
    number = done[-1][0] + 1 if done else 1
    body = {"folder": folder.rsplit("/", 1)[1], "files": file_digests(spark, folder) if checked else None}
    target = f"{path.rstrip('/')}/manifest/{number:010d}-{body['folder']}"
    draft, fs = _fs(spark, f"{target}.draft")
    out = fs.create(draft, True)
    out.write(json.dumps(body, indent=1).encode())
    out.close()
    fs.rename(draft, _fs(spark, f"{target}.json")[0])


def current(spark: SparkSession, path: str, check: bool = False) -> str:
    """Folder of the newest complete version; ``check`` compares its files with the manifest."""
    done = _manifests(spark, path)
    if not done:
        raise FileNotFoundError(f"{path} has no complete version")
    where, fs = _fs(spark, done[-1][1])
    stream = fs.open(where)
    body = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    folder = f"{path.rstrip('/')}/{body['folder']}"
    if check and body["files"] is not None and file_digests(spark, folder) != body["files"]:
        raise ValueError(f"the files of {folder} are not those of its manifest")
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where, fs = _fs(spark, path)
    fs.delete(where, True)
