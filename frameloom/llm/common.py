"""Small helpers that the operators of this subpackage share."""
from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import shared_folder

#: A word: a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[str]] = []


def _table(df: DataFrame) -> tuple[str, DataFrame]:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back, for use more than once."""
    return _table(df)[1]


def saved(df: DataFrame) -> DataFrame:
    """Like ``kept``; inside ``scratch`` the table is removed at its end."""
    path, out = _table(df)
    if _open:
        _open[-1].append(path)
    return out


@contextlib.contextmanager
def scratch(spark) -> Iterator[None]:
    """Removes the tables that ``saved`` wrote within; what is to last must be ``kept`` before the end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame already has such a column, so that no column of the caller's is written over."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that the parts decide, uniform over their values."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def text_digest(text: Column) -> Column:
    """What tells texts apart: the SHA-256 of the text, null counting as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def md5_long(*parts: Column) -> Column:
    """60 bits of the parts' MD5 digest, parts joined by colons; any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def once_per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in each Python worker process and used by its later tasks.

    Functions travel to executors by value, so a module's own globals would not outlive a task.
    Only things that every task would make alike belong here, such as vocabularies.
    """
    held = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
