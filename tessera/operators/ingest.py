"""Sources to identified chunks: units or rows -> (doc_id, source_id, serial_number, page_number, chunk_index_in_page, text, metadata)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FrameError, MetadataError

Chunker = Callable[[Column], Column]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise FrameError(f"missing columns: {', '.join(missing)}")


def unique_ids(df: DataFrame, id_col: str) -> DataFrame:
    """df, or FrameError naming an id that repeats as text."""
    again = df.groupBy(F.col(id_col).cast("string").alias("id")).count().where("count > 1").first()
    if again:
        raise FrameError(f"repeated id: {again['id']}")
    return df


def metadata_json(df: DataFrame, *without: str) -> Column:
    """All other columns as one JSON object."""
    rest = [c for c in df.columns if c not in without]
    return F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")


def split_metadata(fields: dict, core: tuple[str, ...] = ("doc_id", "text", "db_name", "distance")) -> tuple[dict, dict]:
    """(core fields, metadata) of keyword arguments; `id` names the document and wins over a given doc_id."""
    fields = dict(fields)
    if "id" in fields:
        fields["doc_id"] = fields.pop("id")
    if fields.get("doc_id") is None:
        raise MetadataError("doc_id is required")
    return {k: v for k, v in fields.items() if k in core}, {k: v for k, v in fields.items() if k not in core}


def from_units(units: DataFrame, chunker: Chunker) -> DataFrame:
    """Units (source_id, file_path, unit_index, page_number, text): serials run through a source's units, places restart in each."""
    require(units, "source_id", "file_path", "unit_index", "page_number", "text")
    cut = units.select("source_id", "file_path", "unit_index", "page_number", F.posexplode(chunker(F.col("text"))).alias("chunk_index_in_page", "text"))
    serial = (F.row_number().over(Window.partitionBy("source_id").orderBy("unit_index", "chunk_index_in_page")) - 1).cast("int")
    out = cut.withColumn("serial_number", serial)
    return _chunks(out, F.to_json(F.struct("file_path", "serial_number", "page_number", "chunk_index_in_page")))


def from_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document per row; every other column is metadata."""
    require(df, id_col, text_col)
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), metadata_json(df, id_col, "text").alias("metadata"))


def from_rows_chunked(df: DataFrame, id_col: str, text_col: str, chunker: Chunker) -> DataFrame:
    """Chunks of each row; serials restart per row, the page is 1 unless given."""
    require(df, id_col, text_col)
    page = F.coalesce(F.nullif(F.col("page_number").cast("int"), F.lit(0)), F.lit(1)) if "page_number" in df.columns else F.lit(1)
    cut = df.select(F.col(id_col).cast("string").alias("source_id"), page.alias("page_number"), metadata_json(df, text_col, "page_number").alias("row_json"), F.posexplode(chunker(F.col(text_col))).alias("serial_number", "text"))
    return _chunks(cut.withColumn("chunk_index_in_page", F.col("serial_number")), F.col("row_json"))


def _chunks(df: DataFrame, metadata: Column) -> DataFrame:
    return df.select(F.concat("source_id", F.lit("_No."), "serial_number").alias("doc_id"), "source_id", "serial_number", "page_number", "chunk_index_in_page", "text", metadata.alias("metadata"))
