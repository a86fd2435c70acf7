"""Tables of iterative operators, in the folder that driver and executors share.

That folder is the session's ``spark.checkpoint.dir``; only where it is unset (tests, a single machine) a local one is made. A table
cuts the lineage of a round: a lost executor costs a re-read. Tables of one run stand in one folder and go with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


class Scratch:
    """The tables of one run: ``keep`` writes one, ``close`` deletes all but the one that is the result."""

    def __init__(self, spark: SparkSession, name: str):
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not _own:
                _own.append("file://" + tempfile.mkdtemp(prefix="velograde-"))
            found = _own[0]
        self.spark, self.root = spark, f"{found.rstrip('/')}/velograde/{name}-{uuid.uuid4().hex[:12]}"
        self.made: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(back)] = path
        self._alive = [*getattr(self, "_alive", []), back]
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if (path := self.made.get(id(df))) is not None:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def close(self, *results: DataFrame) -> None:
        self.drop(*[df for df in getattr(self, "_alive", []) if all(df is not r for r in results)])
