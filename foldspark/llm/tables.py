"""Tables between the steps of an operator: written once, size-checked, and cleaned up."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.session import materialize, release

# Narrow lookup sides (a few numbers a row) are broadcast up to this counted number of rows.
NARROW_ROWS = 300_000


def settle(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``used`` tables are deleted.

    Collecting the driver's garbage lets Spark drop the shuffle files of finished steps, so
    that an operator of many steps holds those of one step on disk at a time.
    """
    table = materialize(df, f"llm-{label}")
    release(*used)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def bounded(table: DataFrame, rows: int = NARROW_ROWS) -> DataFrame:
    """``table`` (written, narrow) marked for broadcast only if its counted rows allow it."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def document_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a document. Rows with equal id and text are one document, so that null
    and repeated ids are told apart by their text; joins compare the id as well."""
    return F.xxhash64(doc_id, text)


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (k, doc_id, text): other columns, whatever their names, stay outside."""
    return docs.select(
        document_key(F.col(doc_id), F.col(text)).alias("k"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
    )


def join_documents(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join two tables that have (k, doc_id); the columns of ``right`` follow."""
    other = right.withColumnsRenamed({"k": "_k", "doc_id": "_doc_id"})
    same = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = left.join(other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_k", "_doc_id")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, whatever their names, beside ``keys``."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])


def attach(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``), k, doc_id and the other columns of ``verdicts`` (k, doc_id, ...)."""
    keyed = packed(docs, k=document_key(F.col("doc_id"), F.col("text")), doc_id=F.col("doc_id"))
    return join_documents(keyed, verdicts)


def fold_of(doc_id: Column, folds: int) -> Column:
    """Fold of a document by its id alone; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")
