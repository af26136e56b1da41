"""Text functions, Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefixes by model family: (query, passage). Fixed values of the public models.
PREFIXES = {"e5": ("query: ", "passage: "), "ruri": ("クエリ: ", "文章: "), "ruri-v3": ("検索クエリ: ", "検索文書: ")}


def ascii_lower(c: Column) -> Column:
    """A-Z only; other scripts keep their case."""
    return F.translate(c, UPPER, LOWER)


def tokenize(c: Column, stop: list[str] | None = None) -> Column:
    """Runs of letters and digits, ASCII lower-cased: the stand-in for a morphological analyser."""
    tokens = F.regexp_extract_all(ascii_lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return drop_stop_words(tokens, stop) if stop else tokens


def drop_stop_words(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(F.array(*map(F.lit, stop)), t))


def morphological(c: Column, analyse, keep: tuple[str, ...] = ("名詞", "動詞", "形容詞"), stop: tuple[str, ...] = (), batched: bool = False) -> Column:
    """Tokens by a plugged-in analyser: analyse(text) -> [(part of speech, normalised form)], called in Python workers on
    ASCII-lowered text; batched: analyse(texts) -> one such list a text, called once a batch. Only the parts of speech to keep (all if there are none) and no stop words go on; null text has no token."""

    def kept(found) -> list[str]:
        return [w for part, w in found if (not keep or part in keep) and w not in stop]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = [t for t in s if t is not None]
            found = iter(analyse(there) if batched and there else map(analyse, there))
            yield pd.Series([kept(next(found)) if t is not None else [] for t in s], dtype=object)

    return F.pandas_udf(run, ArrayType(StringType()))(ascii_lower(c))


def load_plugin(name: str):
    """The object that 'module:attribute' names: how a configuration plugs in an analyser, embedder or evaluator."""
    from importlib import import_module

    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def with_prefix(c: Column, family: str, mode: str | None) -> Column:
    """mode: query, passage or None."""
    if mode not in ("query", "passage", None):
        raise ValueError(f"mode must be query, passage or None, not {mode!r}")
    return c if mode is None else F.concat(F.lit(PREFIXES[family][mode == "passage"]), c)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def html_text(c: Column) -> Column:
    """Trimmed text nodes joined by one space; scripts, styles, templates, comments and doctypes go."""
    mark = "\x01"
    for tag in ("script", "style", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", mark)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", mark)
    c = F.regexp_replace(c, r"(?s)<[!/?a-zA-Z][^>]*>", mark)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s\x01]*\x01[\s\x01]*", " "), r"^\s+|\s+$", ""))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title", 1))


def basic_entities(c: Column) -> Column:
    """The predefined character references, without Python; `unescape` knows all."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def item_name(s: pd.Series) -> pd.Series:
    """NFKC, trimmed, lower-cased; Spark has no NFKC of its own."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).strip().lower(), na_action="ignore")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def optional(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def link(base: Column, replica: Column, unid: Column) -> Column:
    parts = [optional(x) for x in (base, replica, unid)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat(parts[0], parts[1], F.lit("/0/"), parts[2]))


def markdown_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def markdown_target(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def table_cell(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"\r\n?", "\n"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def safe_name(c: Column, fallback: str = "attachment") -> Column:
    c = F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[ .]+$", ""), F.lit("")), F.lit(fallback))


def compact_base64(c: Column, least: int = 64) -> Column:
    """Without white space and padded; null if short or not base64."""
    bare = F.regexp_replace(c, r"[\s=]", "")
    ok = (F.length(bare) >= least) & bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1)
    return F.when(ok, F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("=")))


def decode_base64(c: Column, least: int = 64) -> Column:
    return F.try_to_binary(compact_base64(c, least), F.lit("base64"))


def image_kind(data: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return (F.when(head.rlike("^47494638(37|39)61"), "gif").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8"), "jpg")
            .when(head.startswith("424D"), "bmp").when(head.rlike("^(49492A00|4D4D002A)"), "tif").when(head.rlike("^52494646.{8}57454250"), "webp"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
