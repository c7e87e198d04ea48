"""Tables that are replaced whole: readers see one version or the next, and of two writers only one makes it.

A version is a folder of data, written under a name of its own, and then a small file `_versions/<number>` that names it. That
file is created only if it isn't there, which is what decides between writers. Each version carries the generation of its writer: one
of an older generation than the newest version's is refused, so a writer that was superseded can't bring back old rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleWriter(RuntimeError):
    """Another writer was first, or a newer generation has taken over."""


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    return hadoop, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are, in order; none if nothing was published."""
    _, folder, fs = _hadoop(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return sorted(int(n) for n in names if re.fullmatch(r"\d{20}", n))


def version(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """number, data (folder) and generation of a version, by default the newest; None if there is none."""
    if number is None:
        there = versions(spark, path)
        if not there:
            return None
        number = there[-1]
    return json.loads(spark.read.text(f"{path}/_versions/{number:020d}", wholetext=True).first()[0])


def _claim(spark: SparkSession, path: str, number: int, body: str) -> bool:
    """Create a version's file with its content at once; False if it is there already."""
    hadoop, target, fs = _hadoop(spark, f"{path}/_versions/{number:020d}")
    draft = hadoop.fs.Path(f"{path}/_versions/.{number:020d}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(body.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a hard link is exclusive, a rename on a local disk isn't
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        context = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        return True
    except FileExistsError:
        return False
    except Exception as error:
        if fs.exists(target) and "AlreadyExists" in str(error):
            return False
        raise
    finally:
        fs.delete(draft, False)


def publish(df: DataFrame, path: str, generation: int = 0, expected: int | None = None, form: str = "json") -> int:
    """Publish a table as the next version; its number.

    expected: the version that df was made from (0: none); another one in between raises StaleWriter, as does a newest version of
    a greater generation. Without it the rows replace whatever is newest. df may come from the path itself.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    name = uuid.uuid4().hex
    data = f"{path}/data/{name}"
    df.write.format(form).save(data)
    while True:
        newest = version(spark, path)
        number = newest["number"] if newest else 0
        fenced = newest is not None and newest["generation"] > generation
        if not fenced and (expected is None or expected == number):
            if _claim(spark, path, number + 1, json.dumps({"number": number + 1, "data": name, "generation": generation, "form": form})):
                return number + 1
            if expected is None:
                continue
        _, folder, fs = _hadoop(spark, data)
        fs.delete(folder, True)
        raise StaleWriter(f"{path}: version {number} of generation {newest['generation']} came first" if newest else path)


def published(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The folder with a version's rows, by default the newest one's; the path itself where nothing was published."""
    found = version(spark, path.rstrip("/"), number)
    return f"{path.rstrip('/')}/data/{found['data']}" if found else path


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the newest `keep` and folders that no version names; the number of folders deleted.

    For a time without writers: a folder that is being written has no version yet.
    """
    path = path.rstrip("/")
    there = versions(spark, path)
    used = {version(spark, path, n)["data"] for n in there[-keep:]}
    for n in there[:-keep]:
        _, old, fs = _hadoop(spark, f"{path}/_versions/{n:020d}")
        fs.delete(old, False)
    _, folder, fs = _hadoop(spark, f"{path}/data")
    gone = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName() not in used]
    for old in gone:
        fs.delete(old, True)
    return len(gone)
