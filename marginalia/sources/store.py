"""A versioned store of batch tables: merge on read, tombstones, and compaction.

Every batch of an ingest is a partition ``batch_id`` of each table, written whole or again. The table ``documents`` has a row
per document and version; a document's rows are those of its newest version. A deleted document has a newest version of
status ``deleted`` and no other rows, so all tables, vectors included, forget it at once.

``compact`` writes what is current into a new folder and then commits one row in ``compactions``. Readers take the
newest committed row: its folder, and the batches after it. A driver that is lost before the commit leaves a
folder that nobody reads, and a second commit of the same number fails, so a compaction is simply run again.
``obsolete`` names the folders that a commit made superfluous; ``vacuum`` removes them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import tables

DELETED = "deleted"
_COMPACTION = "number int, folder string, upto bigint"


def write(rows: DataFrame, root: str, table: str, batch_id: int, *order: str) -> None:
    """Write one batch of a table, sorted within its files; writing it again replaces it."""
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).sortWithinPartitions(*order)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(f"{root}/{table}")


def batch(spark: SparkSession, root: str, table: str, ddl: str, batch_id: int) -> DataFrame:
    """One batch of a table."""
    rows = tables.read_batches(spark, root, table, ddl)
    return rows.filter(F.col("batch_id") == batch_id).drop("batch_id")


def every(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    """All batches of a table that belongs to no document."""
    return tables.read_batches(spark, root, table, ddl).drop("batch_id")


def keep(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written to shared storage and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def compaction(spark: SparkSession, root: str) -> tuple[int, str, int] | None:
    """Number, folder and last batch of the newest committed compaction."""
    try:
        rows = spark.read.schema(_COMPACTION).parquet(f"{root}/compactions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = rows.agg(F.max(F.struct("number", "folder", "upto"))).first()[0]
    return tuple(found) if found else None


def _documents(spark: SparkSession, root: str, ddl: str, after: int | None) -> DataFrame:
    rows = tables.read_batches(spark, root, "documents", ddl)
    return rows if after is None else rows.filter(F.col("batch_id") > after)


def current(spark: SparkSession, root: str, table: str, ddl: str, documents_ddl: str) -> DataFrame:
    """Rows of the newest version of every document that is not deleted, with their ``batch_id``.

    Batches that are part of a compaction are not opened; its rows lose the documents that have a later version.
    """
    last = compaction(spark, root)
    after = last[2] if last else None
    documents = _documents(spark, root, documents_ddl, after)
    rows = tables.read_batches(spark, root, table, ddl)
    rows = tables.current_rows(rows if after is None else rows.filter(F.col("batch_id") > after), documents)
    if table == "documents":
        rows = rows.filter(F.col("status") != DELETED)
    if last is None:
        return rows
    base = spark.read.schema(f"{ddl}, batch_id bigint").parquet(f"{last[1]}/{table}")
    base = base.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return base.select(*rows.columns).unionByName(rows)


def delete(ids: DataFrame, root: str, batch_id: int, documents_ddl: str) -> None:
    """Delete documents (document_id): one batch of tombstones."""
    types = {f.name: f.dataType for f in ids.sparkSession.createDataFrame([], documents_ddl).schema.fields}
    known = {"document_id": F.col("document_id"), "status": F.lit(DELETED), "updated_at": F.current_timestamp()}
    columns = [known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()]
    tables.write_batch(ids.select("document_id").distinct().select(*columns), root, "documents", batch_id)


def compact(spark: SparkSession, root: str, wanted: dict[str, str], documents_ddl: str) -> tuple[int, str, int] | None:
    """Write the current rows of the tables ``wanted`` (name to columns) and of documents as one, and commit it.

    Covers all batches that are finished now; None if there is nothing new.
    """
    last = compaction(spark, root)
    documents = _documents(spark, root, documents_ddl, last[2] if last else None)
    upto = documents.agg(F.max("batch_id")).first()[0]
    if upto is None:
        return last
    folder = f"{root}/compacted-{uuid.uuid4().hex}"
    for table, ddl in {**wanted, "documents": documents_ddl}.items():
        rows = current(spark, root, table, ddl, documents_ddl).filter(F.col("batch_id") <= upto)
        rows.sortWithinPartitions("document_id").write.parquet(f"{folder}/{table}")
    number = last[0] + 1 if last else 1
    row = spark.createDataFrame([(number, folder, upto)], _COMPACTION)
    # One file in a folder of its own: it is there or it is not, and a second one of this number fails.
    row.coalesce(1).write.mode("errorifexists").parquet(f"{root}/compactions/commit={number}")
    return number, folder, upto


def obsolete(spark: SparkSession, root: str, wanted: list[str]) -> list[str]:
    """Folders that the newest compaction replaces: batches it covers, and older compactions."""
    last = compaction(spark, root)
    if last is None:
        return []
    fs, path = _file_system(spark, root)
    out = []
    for table in [*wanted, "documents"]:
        for status in fs.globStatus(path(f"{root}/{table}/batch_id=*")) or []:
            name = status.getPath().toString()
            if int(name.rpartition("=")[2]) <= last[2]:
                out.append(name)
    for status in fs.globStatus(path(f"{root}/compacted-*")) or []:
        name = status.getPath().toString()
        if not name.endswith(last[1].rpartition("/")[2]):
            out.append(name)
    return out


def vacuum(spark: SparkSession, root: str, wanted: list[str]) -> int:
    """Remove ``obsolete`` folders once no reader uses them; returns how many."""
    fs, path = _file_system(spark, root)
    found = obsolete(spark, root, wanted)
    for name in found:
        fs.delete(path(name), True)
    return len(found)


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path
