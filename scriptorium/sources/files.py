"""Files in and out: documents and images as rows, adapters for renderers and recognisers, text sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import filled

# The image files read, pages of a document rendered at most.
IMAGE_GLOB, PDF_GLOB, MOST_PAGES = "*.{jpg,jpeg,png,bmp,tiff,tif}", "*.pdf", 50
PAGES = "path string, page_idx int, image binary, text string, status string, error string"

#: Turns a file's bytes into (page number, image bytes or None, embedded text or None).
Renderer = Callable[[bytes], Iterable[tuple[int, bytes | None, str | None]]]
#: Turns a page image into text.
Recogniser = Callable[[bytes], str]


def read_files(spark: SparkSession, path: str, glob: str = IMAGE_GLOB) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_pages(files: DataFrame, renderers: list[Renderer], most: int = MOST_PAGES) -> DataFrame:
    """Pages by the first renderer that gives any; failures are rows with status and error, not failed tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                problems = []
                for renderer in renderers:
                    try:
                        pages = [p for p in renderer(bytes(content)) if p[0] < most]
                    except Exception as problem:  # a renderer is foreign code: its failure is data
                        problems.append(f"{type(problem).__name__}: {problem}")
                        continue
                    if pages:
                        rows += [(path, i, image, text, "ok", None) for i, image, text in pages]
                        break
                else:
                    rows.append((path, 0, None, None, "error", "; ".join(problems) or "no pages"))
            yield pd.DataFrame(rows, columns=["path", "page_idx", "image", "text", "status", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("pages"))


def recognise(pages: DataFrame, engines: dict[str, Recogniser], key: str = "doc_id") -> DataFrame:
    """(key, engine, ord, text): each engine's reading of each page image; a failure reads as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, image in zip(batch[key], batch["image"], strict=True):
                for order, (name, engine) in enumerate(engines.items()):
                    try:
                        text = engine(bytes(image)) if image is not None else ""
                    except Exception:  # foreign code, as above
                        text = ""
                    rows.append((ident, name, order, text))
            yield pd.DataFrame(rows, columns=[key, "engine", "ord", "text"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "image").mapInPandas(run, f"{key} {kind}, engine string, ord int, text string")


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    """Texts that are not blank, as text files."""
    df.where(F.trim(filled(F.col(text))) != "").select(F.col(text).alias("value")).write.text(path)
