"""Search documents of many tenants and versions as one partitioned table, with a log that says which of them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import documents as D

KEY = ["tenant_id", "index_version", "generation"]
#: States whose rows vacuum removes.
GONE = ("failed", "pruned")


class DocumentStore:
    """Documents under ``root``/documents, partitioned by tenant, version and generation; states under ``root``/versions.

    The log of states only grows: each change appends one file with all of its rows, and a version's state is its newest row. Documents are
    written first and the log last, so a reader sees a version whole or not at all, and a job that dies in between leaves
    rows that nobody reads until ``vacuum`` removes them. Building again or projecting again writes a new generation and never
    touches files that a reader may have open. One writer at a time.

    documents: the schema of the documents, with tenant_id and index_version."""

    def __init__(self, spark: SparkSession, root: str, documents: StructType):
        self.spark, self.root = spark, root.rstrip("/")
        fields = {f.name: f.dataType for f in documents.fields}
        self.columns = documents.fieldNames()
        ddl = f"seq long, tenant_id {fields['tenant_id'].simpleString()}, version {fields['index_version'].simpleString()}, status string, generation long"
        self._log_schema = ddl
        body = [f for f in documents.fields if f.name not in KEY]
        self._schema = StructType(body + [documents["tenant_id"], documents["index_version"]]).add("generation", "long")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str, schema) -> DataFrame:
        fs, path = self._path(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _next(self) -> int:
        return (self._read("versions", self._log_schema).agg(F.max("seq")).first()[0] or 0) + 1

    def _append(self, rows: DataFrame) -> None:
        """rows: tenant_id, version, status, generation. One file, so that they count together."""
        rows.select(F.lit(self._next()).cast("long").alias("seq"), "tenant_id", "version", "status", F.col("generation").cast("long")).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def versions(self) -> DataFrame:
        """tenant_id, version, status, generation as they are now.

        The filter pins them: Spark takes two scans of one folder for the same, whatever files each has listed."""
        newest = self._read("versions", self._log_schema).where(F.col("seq") < self._next()).groupBy("tenant_id", "version").agg(F.max_by(F.struct("status", "generation"), "seq").alias("s"))
        return newest.select("tenant_id", "version", "s.status", "s.generation").where("status <> 'pruned'")

    def _change(self, after: DataFrame) -> None:
        before = self.versions().select("tenant_id", "version", F.col("status").alias("_was"))
        self._append(after.join(before, ["tenant_id", "version"]).where("status <> _was").drop("_was"))

    def _write(self, docs: DataFrame, generation: int) -> None:
        keyed = docs.select(*self.columns).withColumn("generation", F.lit(generation).cast("long"))
        keyed.repartition(*KEY[:2], F.pmod(F.xxhash64("product_id"), F.lit(64))).write.mode("append").partitionBy(*KEY).parquet(f"{self.root}/documents")

    def build(self, docs: DataFrame, products: DataFrame, versions: DataFrame) -> DataFrame:
        """Writes the documents of the versions (tenant_id, version) to build; those with a document for each live product are then validated, others failed.

        An active version is not built again: use reproject."""
        active = self.versions().where("status = 'active'").select("tenant_id", "version")
        wanted = versions.select("tenant_id", "version").distinct().join(active, ["tenant_id", "version"], "left_anti")
        generation = self._next()
        self._append(wanted.select("*", F.lit("building").alias("status"), F.lit(generation).alias("generation")))
        mine = self.versions().where(F.col("generation") == generation)
        key = mine.select("tenant_id", F.col("version").alias("index_version"))
        self._write(docs.join(key, ["tenant_id", "index_version"], "left_semi"), generation)
        written = self._read("documents", self._schema).where(F.col("generation") == generation).groupBy("tenant_id", F.col("index_version").alias("version")).agg(F.count("*").alias("docs"), F.count_distinct("product_id").alias("ids"))
        live = D.live(products).groupBy("tenant_id").agg(F.count_distinct("product_id").alias("live"))
        n = lambda c: F.coalesce(c, F.lit(0))
        judged = mine.drop("status").join(written, ["tenant_id", "version"], "left").join(live, "tenant_id", "left")
        self._append(judged.withColumn("status", F.when((n("docs") == n("live")) & (n("ids") == n("live")), "validated").otherwise("failed")))
        return self.versions().where(F.col("generation") == generation)

    def publish(self, wanted: DataFrame) -> None:
        """Readers see each tenant's wanted version (tenant_id, version) from here on, if it is validated."""
        self._change(D.publish_versions(self.versions(), wanted))

    def rollback(self, tenant) -> None:
        self._change(D.rollback_version(self.versions(), tenant))

    def recover(self) -> None:
        """Versions that a dead job left unfinished fail."""
        unfinished = F.col("status").isin("building", "validating")
        self._change(self.versions().withColumn("status", F.when(unfinished, "failed").otherwise(F.col("status"))))

    def prune(self, keep: int = 2) -> None:
        """Forgets inactive versions but the newest ``keep`` of each tenant, and removes their files."""
        now = self.versions()
        self._append(now.join(D.prune_versions(now, keep), ["tenant_id", "version"], "left_anti").withColumn("status", F.lit("pruned")))
        self.vacuum()

    def reproject(self, products: DataFrame, rebuild) -> None:
        """Projects all live products again into each tenant's active version; ``rebuild`` makes the documents of the products it is given.

        The new generation takes the place of the old one in the log once it is whole. Deleted products lose their documents."""
        active = self.versions().where("status = 'active'")
        generation = self._next()
        fresh = rebuild(D.live(products)).drop("index_version").join(active.select("tenant_id", F.col("version").alias("index_version")), "tenant_id")
        self._write(fresh, generation)
        self._append(active.withColumn("generation", F.lit(generation)))

    def read(self, status: str = "active") -> DataFrame:
        """The documents of the versions of a state. The states are few rows beside the documents; Spark prunes partitions by them."""
        chosen = self.versions().where(F.col("status") == status).select("tenant_id", F.col("version").alias("index_version"), "generation")
        return self._read("documents", self._schema).where(F.col("generation") < self._next()).join(chosen, KEY, "left_semi").select(self.columns)

    def vacuum(self) -> int:
        """Removes partitions that no version of the log reads; no reader of these may be left. The number of those removed.

        Names of partitions are matched by Spark; documents are not read."""
        fs, path = self._path("documents")
        if not fs.exists(path):
            return 0
        kept = self.versions().where(~F.col("status").isin(*GONE)).select(F.col("generation").cast("string").alias("g"), F.col("tenant_id").cast("string").alias("t"), F.col("version").cast("string").alias("v"))
        files = self._read("documents", self._schema).select(*KEY, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
        old = files.join(kept, (F.col("generation").cast("string") == F.col("g")) & F.col("tenant_id").cast("string").eqNullSafe(F.col("t")) & (F.col("index_version").cast("string") == F.col("v")), "left_anti")
        n = 0
        for r in old.select("folder").toLocalIterator():  # folders, one at a time
            uri = self.spark._jvm.java.net.URI(r.folder)
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(uri), True)
            n += 1
        return n
