"""Files to source units (source_id, file_path, unit_index, page_number, text)."""

from __future__ import annotations

import logging
import re
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileError
from ..functions.text import path_stem, suffix

UNITS = "source_id string, file_path string, unit_index int, page_number int, text string"
LOG = logging.getLogger(__name__)


def decode(raw: bytes) -> str:
    """UTF-8 (with or without mark), then the Japanese legacy sets, then Latin-1, which takes anything."""
    for name in ("utf-8-sig", "cp932", "euc_jp"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


class _TextNodes(HTMLParser):
    HIDDEN = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.hidden, self.part = [], 0, ""

    def flush(self):
        if (t := self.part.strip()):
            self.nodes.append(t)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.flush()
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.part += data


def html_to_text(html: str) -> str:
    """Trimmed text nodes, references decoded, joined by one space."""
    p = _TextNodes()
    p.feed(html)
    p.close()
    p.flush()
    return " ".join(p.nodes)


def _texts(element, name: str) -> str:
    return "".join(x.text or "" for x in element.iter() if x.tag.rpartition("}")[2] == name)


def docx_units(raw: bytes) -> list[tuple[int, str]]:
    """(paragraph number, text) of non-empty paragraphs; empty ones keep their number."""
    with ZipFile(BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = [p for p in body.iter() if p.tag.rpartition("}")[2] == "p"]
    return [(k, t) for k, p in enumerate(paragraphs) if (t := _texts(p, "t").strip())]


def pptx_units(raw: bytes) -> list[tuple[int, str]]:
    """(slide number, shape texts by line); blank slides are left out, numbers keep the gaps."""
    out = []
    with ZipFile(BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, (_, name) in enumerate(slides):
            try:
                slide = ElementTree.fromstring(z.read(name))
            except ElementTree.ParseError as e:  # one bad slide is left out, the rest goes on
                LOG.warning("%s left out: %s", name, e)
                continue
            shapes = [s for s in slide.iter() if s.tag.rpartition("}")[2] == "txBody"]
            text = "\n".join("\n".join(_texts(p, "t") for p in s if p.tag.rpartition("}")[2] == "p") for s in shapes)
            if text.strip():
                out.append((k, text))
    return out


def pages(of, text) -> list[tuple[int, str]]:
    """(page, text) by text(page); a page that cannot be read is left empty, the rest goes on."""
    out = []
    for k, page in enumerate(of):
        try:
            out.append((k, text(page) or ""))
        except Exception as e:  # whatever the library raises on a broken page
            LOG.warning("page %d left empty: %s", k, e)
            out.append((k, ""))
    return out


def pdf_units(raw: bytes) -> list[tuple[int, str]]:
    """(page, text), empty pages kept; needs a PDF library."""
    try:
        import fitz
    except ImportError:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise FileError("reading PDF needs PyMuPDF or pypdf") from e
        return pages(PdfReader(BytesIO(raw)).pages, lambda p: p.extract_text())
    with fitz.open(stream=raw, filetype="pdf") as doc:
        return pages(doc, lambda p: p.get_text("text"))


READERS = {"txt": lambda raw: [(0, decode(raw))], "html": lambda raw: [(0, html_to_text(decode(raw)))], "docx": docx_units, "pptx": pptx_units, "pdf": pdf_units}


def units(kind: str, raw: bytes, readers: dict | None = None) -> list[tuple[int, str]]:
    """(number, text) of a file's units; FileError if it cannot be read."""
    reader = (readers or READERS).get(kind)
    if reader is None:
        raise ValueError(f"Unsupported file type: .{kind}")
    try:
        return reader(raw)
    except FileError:
        raise
    except Exception as e:
        raise FileError(f"not a readable {kind} file: {e}") from e


def _read(spark: SparkSession, path: str | list[str], start_page: int, readers: dict | None) -> DataFrame:
    known = readers or READERS
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    other = files.where(~suffix(F.col("path")).isin(*known)).select("path").first()
    if other:
        raise ValueError(f"Unsupported file type: {other['path']}")

    def rows(sid, path, kind, raw):
        try:
            return [(sid, path, n, n + start_page, text, None) for n, text in units(kind, bytes(raw), known)]
        except FileError as e:
            return [(sid, path, None, None, None, str(e))]

    def run(batches):
        for b in batches:
            out = [r for x in zip(b.source_id, b.path, b.kind, b.content) for r in rows(*x)]
            yield pd.DataFrame(out, columns=["source_id", "file_path", "unit_index", "page_number", "text", "error"]).astype({"unit_index": "Int32", "page_number": "Int32"})

    return files.select(path_stem(F.col("path")).alias("source_id"), "path", suffix(F.col("path")).alias("kind"), "content").mapInPandas(run, f"{UNITS}, error string")


def read_files(spark: SparkSession, path: str | list[str], start_page: int = 1, readers: dict | None = None) -> DataFrame:
    """Units of all files; the suffix, in any case, picks the reader (`readers`: suffix to function, READERS if none). An
    unknown suffix fails before any file is read; a file that cannot be read has no units, and `file_errors` names it."""
    return _read(spark, path, start_page, readers).where("error is null").drop("error")


def file_errors(spark: SparkSession, path: str | list[str], readers: dict | None = None) -> DataFrame:
    """(file_path, error) of the files that cannot be read."""
    return _read(spark, path, 1, readers).where("error is not null").select("file_path", "error")


def read_text(spark: SparkSession, path: str, start_page: int = 1) -> DataFrame:
    """UTF-8 text files, whole file per unit, without Python."""
    return spark.read.text(path, wholetext=True).select(path_stem(F.col("_metadata.file_path")).alias("source_id"), F.col("_metadata.file_path").alias("file_path"),
                                                       F.lit(0).alias("unit_index"), F.lit(start_page).alias("page_number"), F.col("value").alias("text"))


_S = T.StringType()
_struct = lambda text, longs=(): T.StructType([*(T.StructField(n, _S) for n in text.split()), *(T.StructField(n, T.LongType()) for n in longs)])
#: Parsed notes documents. Field names are fixed by the file format.
NDJSON = T.StructType([
    T.StructField("doc_id", _S),
    T.StructField("metadata", T.StructType([*_struct("database_title replica_id unid noteid form subject http_link notes_link owner_department").fields, T.StructField("categories", T.ArrayType(_S))])),
    T.StructField("body_text", _S),
    T.StructField("images", T.ArrayType(_struct("image_id rel_path content_hash mime source_tag", ["size_bytes"]))),
    T.StructField("attachments", T.ArrayType(_struct("attachment_id filename rel_path sha256 created modified hosttype flags compression", ["size_bytes", "declared_size"]))),
])


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, categories in five columns, with the file's path and time."""
    raw = spark.read.schema(NDJSON).json(path).select("*", "_metadata.file_path", "_metadata.file_modification_time")
    m = lambda c: F.col(f"metadata.{c}")
    category = [F.coalesce(F.get(m("categories"), F.lit(k)), F.lit("")).alias(f"category_{k + 1}") for k in range(5)]
    return raw.where("doc_id is not null").select(
        F.col("doc_id").alias("source_doc_id"), m("database_title"), m("subject"), "body_text", m("notes_link"), m("http_link"), m("owner_department"), "file_path",
        F.date_format("file_modification_time", "yyyy-MM-dd'T'HH:mm:ss").alias("source_file_modified_at"), F.lit(1).alias("page_number"), *category)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def database_titles(chunks: DataFrame, column: str = "database_title") -> DataFrame:
    """Sorted, trimmed, non-empty, distinct."""
    return chunks.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of these ids; missing ids are skipped."""
    from ..operators.lexical import small

    return df.join(small(ids.select(key).distinct()), key, "left_semi")


def chat_table(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A chat table from Parquet or a database."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{folder}/{name}.parquet")
