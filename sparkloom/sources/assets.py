"""Binary assets: file snapshots and page tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import text as T
from sparkloom.operators import merge

T_PAGES = "page_number int, image_data binary, width int, height int"
PAGES = "filename string, page_number int, image_data binary, width int, height int"
Renderer = Callable[[bytes], list[tuple[bytes, int, int]]]


def read_files(spark: SparkSession, path: str, content_type: str = "application/pdf") -> DataFrame:
    """Whole files as rows."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(T.basename(F.col("path")).alias("filename"), F.lit(content_type).alias("content_type"), F.col("content").alias("file_data"), T.kilobytes(F.col("content")).alias("kb"), F.col("modificationTime").alias("uploaded_at"))


def first_file(files: DataFrame) -> DataFrame:
    """One file: the first by id where the table has ids, else by name."""
    return files.orderBy("id" if "id" in files.columns else "filename").limit(1)


def store(files: DataFrame, renderer: Renderer, folder: str, first_id: int = 1) -> None:
    """Append files and their rendered pages to the tables cv_files and cv_pages below folder."""
    made = merge.surrogate_keys(files, ["filename"], "id", first_id)
    merge.append(made, f"{folder}/cv_files", schemas.CV_FILES)
    pages = merge.surrogate_keys(render_pages(made, renderer), ["filename", "page_number"], "id", first_id)
    merge.append(pages.withColumn("created_at", F.current_timestamp()), f"{folder}/cv_pages", schemas.CV_PAGES)


def render_pages(files: DataFrame, renderer: Renderer) -> DataFrame:
    """One row a page, numbered from 1. The renderer is given: no PDF library is assumed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["filename"], b["file_data"], strict=True):
                rows = [(name, k, img, w, h) for k, (img, w, h) in enumerate(renderer(bytes(data)), 1)]
                yield pd.DataFrame(rows, columns=["filename", "page_number", "image_data", "width", "height"])

    return files.select("filename", "file_data").mapInPandas(run, PAGES)


def register_pages(spark: SparkSession, renderer: Renderer, name: str = "render_pages") -> None:
    """The renderer as a table function for SQL: `select f.filename, p.* from files f, lateral render_pages(f.file_data) p`.

    A null file has no pages.
    """

    @F.udtf(returnType=T_PAGES)
    class Pages:
        def eval(self, data: bytes):
            if data is not None:
                for k, (image, width, height) in enumerate(renderer(bytes(data)), 1):
                    yield k, image, width, height

    spark.udtf.register(name, Pages)


def page(pages: DataFrame, number: int) -> DataFrame:
    """A page by number; no row where it is absent."""
    return pages.where(F.col("page_number") == number).orderBy("filename").limit(1)
