"""Image files to lines: decoding and recognition are the caller's, all between and after them is here.

`decode(content)` gives (width, height, RGBA bytes), `recognise(rgba, width, height)` gives words as (text, confidence, x0,
y0, x1, y1); both run in the tasks, one image at a time. A null file, and one that either function fails on, is a page with
an `error` and without words: it is counted and the others go on; a file of no bytes has no row in Spark's reader. An empty table gives no pages. Other columns are passed on
by `prepared_files`; `read_captures` needs (capture_id, content), capture_id being unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.core import checkpointed
from ebbtide.operators.lines import group_into_lines
from ebbtide.operators.pixels import _prepare, _scaled

Decode = Callable[[bytes], tuple[int, int, bytes]]
Recognise = Callable[[bytes, int, int], list[tuple]]
REPORT = "error string, width int, height int, scale double, inverted boolean, threshold int"
WORD = ("text", "confidence", "x0", "y0", "x1", "y1")
WORDS = f"array<struct<{','.join(f'{c}:{"string" if c == "text" else "double"}' for c in WORD)}>>"
MOST_BYTES = 32 << 20  # of finished images that wait for their batch


def _one(content: bytes | None, wanted: float | None, decode: Decode, how: dict) -> tuple[dict, bytes | None]:
    """The report on one file, and its prepared pixels."""
    try:
        if content is None:
            raise ValueError("no content")
        width, height, rgba = decode(content)
        if width < 1 or height < 1 or len(rgba) != 4 * width * height:
            raise ValueError(f"{len(rgba)} bytes for {width} x {height} pixels")
        rgba, width, height, scale = _scaled(rgba, width, height, None if pd.isna(wanted) else float(wanted))
        rgba, inverted, threshold = _prepare(rgba, **how)
    except Exception as failure:  # whatever a decoder raises is the page's error
        return {"error": f"{type(failure).__name__}: {failure}"}, None
    return {"width": width, "height": height, "scale": scale, "inverted": inverted, "threshold": threshold}, rgba


def _frame(rows: list[dict], last: str) -> pd.DataFrame:
    names = [*(f.split()[0] for f in REPORT.split(", ")), last]
    kinds = {"width": "Int32", "height": "Int32", "scale": "Float64", "inverted": "boolean", "threshold": "Int32"}
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=kinds.get(n, "object")) for n in names})


def prepared_files(files: DataFrame, decode: Decode, content: str = "content", wanted: Column | None = None, invert: str = "auto", stretch: bool = True, binarize: bool = False) -> DataFrame:
    """files with `prepared`: REPORT and `pixels`, scaled (to what is wanted, or as the width asks) and prepared."""
    how = {"invert": invert, "stretch": stretch, "binarize": binarize}

    @F.pandas_udf(f"{REPORT}, pixels binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, scales in batches:
            rows, held = [], 0
            for data, scale in zip(contents, scales, strict=True):
                report, pixels = _one(data, scale, decode, how)
                rows.append({**report, "pixels": pixels})
                held += len(pixels or b"")
                if held > MOST_BYTES:
                    yield _frame(rows, "pixels")
                    rows, held = [], 0
            if rows:
                yield _frame(rows, "pixels")

    return files.withColumn("prepared", run(F.col(content), (F.lit(None) if wanted is None else wanted).cast("double")))


def dealt(files: DataFrame, key: str) -> DataFrame:
    """files over four tasks a core: a number that is named, since Spark would join small images into few tasks by their bytes again."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, key)


@dataclass
class Reading:
    """pages(capture_id, REPORT, words), lines of the pages that were read, and one row (read, skipped, done)."""

    pages: DataFrame
    lines: DataFrame
    counts: DataFrame


def read_captures(files: DataFrame, decode: Decode, recognise: Recognise, wanted: Column | None = None, invert: str = "auto", stretch: bool = True, binarize: bool = False) -> Reading:
    """Every image once: decoded, scaled, prepared, recognised; its words into lines. Pixels never leave their task.

    The pages, which are words alone by then, are written to the checkpoint folder, since lines and counts both read them.
    """
    how = {"invert": invert, "stretch": stretch, "binarize": binarize}

    def read(data: bytes | None, scale: float | None) -> dict:
        report, rgba = _one(data, scale, decode, how)
        if rgba is None:
            return report
        try:
            words = [dict(zip(WORD, (w[0], *map(float, w[1:])), strict=True)) for w in recognise(rgba, report["width"], report["height"])]
        except Exception as failure:  # likewise
            return {"error": f"{type(failure).__name__}: {failure}"}
        return {**report, "words": words}

    @F.pandas_udf(f"{REPORT}, words {WORDS}")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, scales in batches:
            yield _frame([read(data, scale) for data, scale in zip(contents, scales, strict=True)], "words")

    told = files.select("capture_id", run(F.col("content"), (F.lit(None) if wanted is None else wanted).cast("double")).alias("page"))
    pages = checkpointed(told.select("capture_id", "page.*"))
    words = pages.select("capture_id", F.posexplode("words").alias("word_pos", "w")).select("capture_id", "word_pos", "w.*")
    failed = F.count_if(F.col("error").isNotNull())
    return Reading(pages, group_into_lines(words), pages.agg((F.count("*") - failed).alias("read"), failed.alias("skipped"), F.count("*").alias("done")))
