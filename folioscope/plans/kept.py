"""What a load leaves behind for questions: tables and indexes that are written once a session and state of the tables they come from.

A deployment writes them when documents change (operators.upkeep) and questions read them; the queries over a folder of
tables have no load of their own, so the first query that needs one makes it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame

from folioscope.operators.search import index_tokens
from folioscope.operators.textindex import TextIndex
from folioscope.plans.registry import Tables
from folioscope.session import work_dir, written

T = TypeVar("T")
_made: dict[tuple, object] = {}


def _state(t: Tables, source: str) -> tuple:
    """Names, sizes and times of a table's files: another state of the table is loaded anew."""
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{source}.parquet")
    listed = hadoop.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def once(t: Tables, name: str, source: str, make: Callable[[], T]) -> T:
    """What `make` returns, made once for a state of the source table."""
    key = (t.spark.sparkContext.applicationId, t.folder, name, _state(t, source))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def kept(t: Tables, name: str, make: Callable[[], DataFrame], *, source: str = "documents") -> DataFrame:
    """The rows of `make`, written."""
    return once(t, name, source, lambda: written(make()))


def kept_index(t: Tables, name: str, make: Callable[[], DataFrame], key: str, text: str, *, source: str = "documents", tokens: Callable[[Column], Column] = index_tokens) -> TextIndex:
    """A full-text index of the rows of `make`."""

    def build() -> TextIndex:
        index = TextIndex(t.spark, work_dir(t.spark), tokens=tokens)
        index.replace("load", make(), key, text)
        return index

    return once(t, f"index of {name}", source, build)
