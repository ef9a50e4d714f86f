"""Tables that change together: rows in segments, and a manifest that says which segments count.

A commit writes the rows of each table to a folder of its own and then, as the last step, one small manifest. Readers
go by the newest manifest, so they see all tables of a commit or none, also where a writer died between two
tables. A commit also lists the keys whose earlier rows no longer count; reads leave those rows out by one join with the listed keys. Nothing that
exists is rewritten until `compact` does so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Number of the commit that wrote a row.
SEQ = "_seq"


class Conflict(RuntimeError):
    """Another writer committed first; the commit has to be worked out anew."""


@dataclass
class Manifest:
    """A state of the store: its number, the segments in the order of their commits, the schemas of the tables."""

    number: int = 0
    segments: list[dict] = field(default_factory=list)
    schemas: dict[str, str] = field(default_factory=dict)

    @property
    def batches(self) -> set[str]:
        """Names of the commits that were made, also of those that were folded into others."""
        return {b for s in self.segments for b in s["batches"]}

    def facts(self) -> dict[str, float]:
        """Sums of the numbers that the commits told."""
        out: dict[str, float] = {}
        for s in self.segments:
            for name, value in s["facts"].items():
                out[name] = out.get(name, 0) + value
        return out


class Segments:
    """A store at a path that all machines reach, its tables keyed by one column, named alike in all.

    One writer at a time: where the file system renames without replacing (HDFS), the slower of two gets a Conflict;
    elsewhere writers have to take turns. A null key can be written and read but not replaced.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *, partitions: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, dict(partitions or {})
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda p: hadoop.Path(p)
        self._files = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def manifest(self) -> Manifest:
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return Manifest()
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest()
        told = self.spark.read.text(f"{self.path}/manifests/{max(numbers):08d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(told))

    def _switch(self, new: Manifest) -> None:
        """The step that makes a commit count: a complete file gets the next number as its name."""
        final, aside = self._at(f"{self.path}/manifests/{new.number:08d}.json"), self._at(f"{self.path}/manifests/{uuid.uuid4().hex}.part")
        out = self._files.create(aside)
        out.write(bytearray(json.dumps({"number": new.number, "segments": new.segments, "schemas": new.schemas}).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(aside, final):
            self._files.delete(aside, False)
            raise Conflict(f"manifest {new.number} exists")

    # ------------------------------------------------------------ writes

    def commit(self, batch: str, tables: Mapping[str, DataFrame], *, gone: DataFrame | None = None, facts: Mapping[str, float] | None = None) -> bool:
        """Adds the rows of all tables, without the earlier rows of the keys in `gone` (one column, any name); false if the batch was committed before.

        So a batch that is run again after a failure changes nothing twice. Rows may be read from this very store.
        """
        old = self.manifest()
        if batch in old.batches:
            return False
        segment, number = uuid.uuid4().hex, old.number + 1
        schemas = dict(old.schemas)
        for name, rows in tables.items():
            self._write(name, segment, rows.withColumn(SEQ, F.lit(number).cast("long")))
            schemas[name] = rows.schema.json()
        if gone is not None:
            keys = gone.select(F.col(gone.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
            keys.withColumn(SEQ, F.lit(number).cast("long")).write.parquet(f"{self.path}/_gone/segment={segment}")
            schemas["_gone"] = keys.schema.json()
        entry = {"id": segment, "number": number, "tables": sorted(tables), "gone": gone is not None, "batches": [batch], "facts": dict(facts or {})}
        self._switch(Manifest(number, [*old.segments, entry], schemas))
        return True

    def _write(self, name: str, segment: str, rows: DataFrame) -> None:
        rows.write.partitionBy(*self.partitions.get(name, ())).parquet(f"{self.path}/{name}/segment={segment}")

    def compact(self) -> None:
        """Folds all segments into one that holds the rows that count; what it replaces stays on disk for readers that are under way."""
        old = self.manifest()
        segment, number = uuid.uuid4().hex, old.number + 1
        names = sorted(n for n in old.schemas if n != "_gone")
        for name in names:
            self._write(name, segment, self.read(name, at=old).withColumn(SEQ, F.lit(number).cast("long")))
        entry = {"id": segment, "number": number, "tables": names, "gone": False, "batches": sorted(old.batches), "facts": old.facts()}
        self._switch(Manifest(number, [entry], {n: old.schemas[n] for n in names}))

    # ------------------------------------------------------------ reads

    def _rows(self, name: str, at: Manifest) -> DataFrame:
        schema = StructType([*StructType.fromJson(json.loads(at.schemas[name])).fields, StructField(SEQ, LongType())])
        paths = [f"{self.path}/{name}/segment={s['id']}" for s in at.segments if (s["gone"] if name == "_gone" else name in s["tables"])]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, *, at: Manifest | None = None) -> DataFrame:
        """The rows of a table that count, as of the newest manifest or a given one.

        The table of replaced keys is as large as what was changed since the last compaction; Spark broadcasts it where it is small.
        """
        at = at or self.manifest()
        rows = self._rows(name, at)
        if any(s["gone"] for s in at.segments):
            gone = self._rows("_gone", at).groupBy(self.key).agg(F.max(SEQ).alias("_until"))
            rows = rows.join(gone, self.key, "left").where(F.col("_until").isNull() | (F.col(SEQ) >= F.col("_until")))
        return rows.select(*(f.name for f in StructType.fromJson(json.loads(at.schemas[name])).fields))


def nested(parent: DataFrame, children: Mapping[str, DataFrame], key: str, order: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per parent with each child table as an array of structs in the given order; a parent without children has empty arrays.

    Each child is gathered by one aggregation. It is meant for the documents that are asked for: filter the parent and children first.
    """
    out = parent
    for name, rows in children.items():
        rest = [c for c in rows.columns if c != key]
        first = [*order.get(name, ()), *(c for c in rest if c not in order.get(name, ()))]
        listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*first))).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.expr("array()").cast(dict(listed.dtypes)[name])))
    return out
