"""A draw table of round ranges of which an upsert rewrites only those that it touches.

``data/part=<range>/version=<n>`` holds the rows of a range of rounds, and the
newest file below ``manifest`` says which version of each range counts.  A
version is written beside the old one and counts once the manifest that names
it has its final name, so readers see a whole upsert or none of it.  Versions
that neither the newest nor the last manifest names are removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.draws import DrawError, upserted


@dataclass(frozen=True)
class RangeTable:
    """``schema`` names the columns, ``round`` among them; a range has ``2 ** bits`` rounds."""

    spark: SparkSession
    path: str
    schema: str
    bits: int = 8

    # ------------------------------------------------------------------ files

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, number: int | None = None) -> dict:
        """``parts`` (range to version), ``batch`` (the last one taken in), of the newest manifest or a given one."""
        have = self.manifests()
        if not have:
            return {"parts": {}, "batch": -1}
        path, fs = self._at(f"manifest/{have[-1] if number is None else number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, content: dict) -> None:
        """The manifest under a name of its own, then renamed: of two writers of one number the second fails."""
        draft, fs = self._at(f"manifest/_{number:012d}.draft")
        final, _ = self._at(f"manifest/{number:012d}.json")
        out = fs.create(draft, True)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise DrawError(f"another writer has written manifest {number}")

    def _sweep(self) -> None:
        """Remove versions and manifests that are older than the last manifest."""
        have = self.manifests()
        counts = {(part, v) for n in have[-2:] for part, v in self.manifest(n)["parts"].items()}
        for part in {p for p, _ in counts}:
            for name in self._names(f"data/part={part}"):
                if (part, int(name.split("=")[1])) not in counts:
                    path, fs = self._at(f"data/part={part}/{name}")
                    fs.delete(path, True)
        for n in have[:-2]:
            path, fs = self._at(f"manifest/{n:012d}.json")
            fs.delete(path, False)

    # ------------------------------------------------------------------- rows

    def read(self, parts: set[str] | None = None) -> DataFrame:
        """The rows that count; of some ranges only, if given."""
        named = {p: v for p, v in self.manifest()["parts"].items() if parts is None or p in parts}
        if not named:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/part={p}/version={v}" for p, v in sorted(named.items())])

    def upsert(self, rows: DataFrame, arrival: str | None = None, batch: int | None = None) -> set[str]:
        """Put ``rows`` in, the last to arrive of a round staying; the ranges that were rewritten.

        ``arrival`` is a column that rises in the order of arrival; without one
        a round must not come twice in one upsert.  A ``batch`` that was taken
        in before changes nothing, so a stream may repeat it.
        """
        have, numbers = self.manifest(), self.manifests()
        if batch is not None and batch <= have["batch"]:
            return set()
        rows = rows.withColumn("round", F.col("round").cast("long")).persist()
        try:
            if arrival is None and not rows.groupBy("round").count().filter("count > 1").isEmpty():
                raise DrawError("a round comes twice, and no column says which came last")
            part = F.shiftright("round", self.bits)
            touched = {str(r.p) for r in rows.filter("round IS NOT NULL").select(part.alias("p")).distinct().collect()}  # ranges of one batch
            if touched:
                number = (numbers[-1] if numbers else -1) + 1
                old = self.read(touched)
                columns = old.columns
                if arrival is not None and arrival not in columns:
                    old = old.withColumn(arrival, F.lit(None).cast(rows.schema[arrival].dataType))
                new = upserted(old, rows.filter("round IS NOT NULL"), arrival).select(*columns).withColumn("part", F.shiftright("round", self.bits))
                self._write(new, number)
            else:
                number = numbers[-1] + 1 if numbers else 0
            self._commit(number, {"parts": have["parts"] | {p: number for p in touched}, "batch": have["batch"] if batch is None else batch})
        finally:
            rows.unpersist()
        self._sweep()
        return touched

    def _write(self, rows: DataFrame, number: int) -> None:
        """Each range into a folder of its own; what a failed attempt left under this number is replaced."""
        out = rows.withColumn("version", F.lit(number)).repartition("part").write.partitionBy("part", "version")
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/data")
