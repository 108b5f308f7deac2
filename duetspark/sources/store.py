"""A small store of data sets, streams, annotations and runs as Parquet tables, and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables, their columns, and what their enumerated columns may hold.
TABLES = {
    "datasets": "id string, name string, description string, status string, modalities array<string>, created_at timestamp, updated_at timestamp",
    "data_streams": "id string, dataset_id string, modality string, index_name string, sample_rate_hz double, unit string, column_mapping string, data string, metadata string, created_at timestamp",
    "video_annotations": "id string, dataset_id string, timestamp_ms double, end_timestamp_ms double, event_type string, label string, modality string, confidence double, notes string, created_at timestamp",
    "analysis_runs": "id string, dataset_id string, name string, config string, results string, alignment_report string, status string, created_at timestamp, updated_at timestamp",
}
ALLOWED = {
    ("datasets", "status"): ["draft", "processing", "complete", "error"],
    ("analysis_runs", "status"): ["pending", "running", "complete", "error"],
    ("data_streams", "modality"): ["neural", "behavioral", "bio", "psycho"],
    ("video_annotations", "modality"): ["neural", "behavioral", "bio", "psycho"],
}


class Store:
    """Tables below one folder, for one writer at a time and any number of readers.

    A table is the newest of its version folders that is complete, that is, has the marker a Spark job
    leaves at its end. Appending adds files to it; updates and deletions write the next version, and
    only the one before it is kept, for readers that have begun.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """Complete versions of a table in ascending order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    def _path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/v{version}"

    def read(self, name: str, order: str | None = None, descending: bool = False, **equal) -> DataFrame:
        schema, versions = TABLES[name], self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self._path(name, versions[-1]))
        for k, v in equal.items():
            df = df.where(F.col(k) == v)
        return df.orderBy(F.desc(order) if descending else F.asc(order)) if order else df

    @staticmethod
    def invalid(name: str, rows: DataFrame) -> Column:
        bad = F.lit(False)
        for (table, column), values in ALLOWED.items():
            if table == name:
                bad = bad | ~F.coalesce(F.col(column).isin(values), F.lit(True))
        return bad

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows with known columns only; a value that isn't allowed is an error."""
        wanted = self.spark.createDataFrame([], TABLES[name])
        full = wanted.unionByName(rows, allowMissingColumns=True)
        now = {c: F.coalesce(c, F.current_timestamp()) for c in ("created_at", "updated_at") if c in wanted.columns}
        checked = full.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumns(now)
        checked.withColumn("id", F.when(self.invalid(name, checked), F.raise_error(F.lit(f"value not allowed in {name}")).cast("string")).otherwise(F.col("id"))).write.mode("append").parquet(self._path(name, (self._versions(name) or [0])[-1]))

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        """The next version; a failed job leaves the old one in place, and what it wrote is overwritten later."""
        versions = self._versions(name)
        rows.write.mode("overwrite").parquet(self._path(name, (versions or [-1])[-1] + 1))
        for old in versions[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, old))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def update(self, name: str, where: Column, **values) -> None:
        """Sets columns of matching rows, and updated_at where the table has it."""
        df = self.read(name)
        sets = {k: F.lit(v) for k, v in values.items()} | ({"updated_at": F.current_timestamp()} if "updated_at" in df.columns else {})
        self._rewrite(name, df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in sets.items()}))

    def delete(self, name: str, ids: DataFrame) -> None:
        """Rows with these ids; with a data set go its streams, annotations and runs."""
        gone = ids.select("id").distinct()
        self._rewrite(name, self.read(name).join(gone, "id", "left_anti"))
        if name == "datasets":
            for child in ("data_streams", "video_annotations", "analysis_runs"):
                self._rewrite(child, self.read(child).join(gone.withColumnRenamed("id", "dataset_id"), "dataset_id", "left_anti").select(*[f.split()[0] for f in TABLES[child].split(", ")]))


def export_annotations(annotations: DataFrame, path: str) -> None:
    """timestamp_ms, event_type, label, level as CSV; what is missing is empty."""
    cols = ["timestamp_ms", "event_type", "label", "level"]
    have = [F.col(c) if c in annotations.columns else F.lit(None).cast("string").alias(c) for c in cols]
    annotations.select(*have).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def export_timeline(wide: DataFrame, path: str, kind: str = "csv") -> None:
    out = wide.write.mode("overwrite")
    out.csv(path, header=True, nullValue="", emptyValue="") if kind == "csv" else out.json(path)
