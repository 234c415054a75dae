"""Reading pages, documents, sitemaps and logs, in whatever layout they come."""

from __future__ import annotations

import gzip
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import fold_printable, strip
from lodeworks.functions.urls import DOMAIN

PAGE = "url string, title string, description string, text string, html string, status_code int, scraped_at double, content_length int, metadata map<string,string>"


def read_scraped(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Pages from JSON files: a list of pages, an object with pages or scraped_pages, or one page."""
    shape = f"pages array<struct<{_fields(schema)}>>, scraped_pages array<struct<{_fields(schema)}>>, {schema}"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    own = F.array(F.struct(*[f.name for f in T._parse_datatype_string(schema)]))
    return raw.select(F.explode(F.coalesce("pages", "scraped_pages", own)).alias("p")).select("p.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema))


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The path of the most recently changed file that matches."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    return rows[0]["path"] if rows else None


def read_chunk_files(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{folder}/*chunks*", multiLine=True)


def docx_text(raw: bytes, glue: str = "\n") -> str:
    """Paragraphs of a word-processing file, straight from its archive."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    parts = ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]
    return glue.join(p for p in parts if p.strip() or glue == "\n").strip()


def pdf_text(raw: bytes) -> str:
    """Page texts, with whichever PDF library is there."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("no PDF library is installed") from error
    return "".join(f"{p.extract_text()}\n" for p in PdfReader(io.BytesIO(raw)).pages).strip()


def file_text(path: str, raw: bytes) -> tuple[str | None, str | None]:
    """Text and error of an uploaded file, by its ending."""
    end = path.rsplit(".", 1)[-1].lower()
    try:
        if end == "txt":
            return raw.decode("utf-8"), None
        if end == "docx":
            return docx_text(raw, "\n\n"), None
        if end == "pdf":
            return pdf_text(raw), None
        if end == "doc":
            return raw.decode("latin-1"), "read as printable text"
        return None, f"unsupported format: {end}"
    except Exception as error:  # a file that can't be read is a row with its reason
        return None, str(error)


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files as pages with source, file name and size; unreadable ones have an error."""

    @F.pandas_udf("text string, error string")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([file_text(p, c) for p, c in zip(path, content, strict=True)], columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.withColumn("x", run("path", "content")).withColumn("file", F.element_at(F.split("path", "/"), -1))
    text = F.when(F.col("file").rlike("(?i)\\.doc$"), strip(fold_printable(F.col("x.text")))).otherwise(F.col("x.text"))
    meta = F.create_map(F.lit("source"), F.lit("upload"), F.lit("filename"), F.col("file"), F.lit("file_size"), F.col("length").cast("string"))
    return rows.select(F.concat(F.lit("file://"), F.col("file")).alias("url"), F.col("file").alias("title"), text.alias("text"), F.col("x.error").alias("error"), F.lit("upload").alias("source_type"), F.lower(F.element_at(F.split("file", r"\."), -1)).alias("file_type"), meta.alias("metadata"))


def with_uploads(pages: DataFrame, uploads: DataFrame) -> DataFrame:
    return pages.unionByName(uploads, allowMissingColumns=True)


def sitemap_urls(raw: bytes) -> list[tuple[str, str]]:
    """(kind, address) of a sitemap or an index of sitemaps, gzipped or not; plain addresses where it isn't XML."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return [("url", u) for u in re.findall(r"https?://[^\s<>\"']+", raw.decode("utf-8", "replace"))]
    name = lambda x: x.tag.rsplit("}", 1)[-1]
    out = [(name(parent), child.text.strip()) for parent in root.iter() if name(parent) in ("url", "sitemap") for child in parent if name(child) == "loc" and child.text]
    return out or [("url", x.text.strip()) for x in root.iter() if name(x).endswith("loc") and x.text]


def read_sitemaps(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, kind, url) of sitemap files: addresses, and the sitemaps an index names, for a next read."""

    @F.pandas_udf("array<struct<kind: string, url: string>>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: [{"kind": k, "url": u} for k, u in sitemap_urls(b)])

    return files.select("path", F.explode(run(content)).alias("u")).select("path", "u.kind", "u.url")


def robots_sitemaps(robots: DataFrame, column: str = "text") -> DataFrame:
    return robots.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), F.lit(1))).alias("url")).distinct()


def read_interactions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Interactions from JSON lines; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


#: Catalogue of start addresses by category, on the configured domain.
CATALOGUE = {
    "core": ("", "about", "services", "portfolio", "contact", "blog", "team", "careers"),
    "services": ("services/web-development", "services/mobile-development", "services/consulting", "services/cloud-solutions"),
    "portfolio": ("portfolio", "case-studies"),
    "company": ("about/team", "about/history", "careers/jobs"),
}


def url_catalogue(spark: SparkSession, domain: str = DOMAIN, entries: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(category, i, f"https://{domain}/{p}") for category, paths in (entries or CATALOGUE).items() for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "category string, pos int, url string")


def high_priority(catalogue: DataFrame, each: int = 5) -> DataFrame:
    """All core addresses and the first ones of each other category."""
    return catalogue.where((F.col("category") == "core") | (F.col("pos") < each))


def accessible(urls: DataFrame, probe: Callable[[str], int]) -> DataFrame:
    """(url, ok) by a given function that asks for an address's status; a failure or a status from 400 on isn't ok."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for url in batch["url"]:
                try:
                    ok.append(probe(url) < 400)
                except Exception:  # an address that can't be asked isn't accessible
                    ok.append(False)
            yield pd.DataFrame({"url": batch["url"], "ok": ok})

    return urls.select("url").mapInPandas(run, "url string, ok boolean")


def fetch_stats(fetched: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return fetched.groupBy("method_used").agg(F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.expr("coalesce(sum(content_length) div nullif(count_if(error is null), 0), 0)").alias("average_length"))


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped lines that are web addresses."""
    return lines.select(F.trim(column).alias("url")).where(F.col("url").rlike("^https?://"))
