"""Words with boxes to visual lines.

Words: (capture_id, word_pos, text, confidence, x0, y0, x1, y1). The only sequential step, in which row a word falls, is a
fold over the words of one capture (a page, so of bounded size); all that follows is grouping.

Blank words and boxes without height are dropped; an empty page has no lines.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators.paging import fold_pages

# The share of the smaller height that must overlap; the gap, in line heights, that splits a line.
LEAST_OVERLAP, SEGMENT_GAP = 0.5, 1.5
ARTEFACT_CONFIDENCE = 40


def words_of_blocks(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Words of a nested OCR result (blocks, paragraphs, lines, words with bbox), in reading order. Null: no words."""
    flat = F.flatten(F.transform(blocks, lambda x: x["paragraphs"]))
    flat = F.flatten(F.transform(flat, lambda x: x["lines"]))
    flat = F.flatten(F.transform(flat, lambda x: x["words"]))
    return pages.select("capture_id", F.posexplode(flat).alias("word_pos", "w")).select("capture_id", "word_pos", "w.text", "w.confidence", "w.bbox.*")


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared height over the smaller height."""
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(shared > 0, shared / F.least(a1 - a0, b1 - b0)).otherwise(0.0)


class _OpenRows:
    """Rows by height class (a power of two) and top, so that a word meets the rows near it alone.

    A row of a class is no higher than its class says, so those that reach below a word's top begin within that height of it.
    """

    def __init__(self):
        self.extent: list[tuple[float, float]] = []
        self.tops: dict[int, list[tuple[float, int]]] = {}

    @staticmethod
    def _class(height: float) -> int:
        return math.frexp(height)[1]

    def put(self, row: int, top: float, bottom: float) -> None:
        if row < len(self.extent):
            a, b = self.extent[row]
            held = self.tops[self._class(b - a)]
            del held[bisect_left(held, (a, row))]
            top, bottom = min(a, top), max(b, bottom)
            self.extent[row] = (top, bottom)
        else:
            self.extent.append((top, bottom))
        insort(self.tops.setdefault(self._class(bottom - top), []), (top, row))

    def near(self, top: float, bottom: float) -> list[int]:
        """Rows that may share height with a word, oldest first."""
        found = []
        for size, held in self.tops.items():
            found += [row for _, row in held[bisect_left(held, (top - math.ldexp(1.0, size), -1)) : bisect_left(held, (bottom, -1))]]
        return sorted(found)


def _rows_of_page(page: list[tuple]) -> list[tuple]:
    """A row number for each word: the row it overlaps most (the later of equals), whose extent it then widens."""
    rows, out = _OpenRows(), []
    for joined, (capture, word, y0, y1, _) in enumerate(page):
        chosen, most = len(rows.extent), LEAST_OVERLAP
        for k in rows.near(y0, y1):
            a, b = rows.extent[k]
            shared = min(b, y1) - max(a, y0)
            ratio = shared / min(b - a, y1 - y0) if shared > 0 else 0
            if ratio >= most:
                chosen, most = k, ratio
        rows.put(chosen, y0, y1)
        out.append((capture, word, chosen, joined))
    return out


def assign_rows(words: DataFrame) -> DataFrame:
    """words with `row` (within its capture) and `joined` (the order in which words joined); word_pos is unique in a capture."""
    usable = words.where((F.trim("text") != "") & (F.col("y1") > F.col("y0")))
    asked = usable.select("capture_id", "word_pos", "y0", "y1", ((F.col("y0") + F.col("y1")) / 2).alias("center"))
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema}
    found = fold_pages(asked, "capture_id", ["center", "word_pos"], _rows_of_page, f"capture_id {kinds['capture_id']}, word_pos {kinds['word_pos']}, row int, joined int")
    return usable.join(found, ["capture_id", "word_pos"])


def assemble_lines(placed: DataFrame) -> DataFrame:
    """Words that know their row, as lines: text, segments, words, box, confidence (weighted by length, one decimal)."""
    heights = F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy("capture_id", "row"))
    along = Window.partitionBy("capture_id", "row").orderBy("x0", "joined")
    cut = F.coalesce((F.col("x0") - F.lag("x1").over(along) > SEGMENT_GAP * F.col("_height")).cast("int"), F.lit(0))
    split = placed.withColumn("_height", heights).withColumn("_cut", cut).withColumn("_segment", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(along))
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_segment", "text", "confidence", "x0", "y0", "x1", "y1")))
    size = F.sum(F.length("text"))
    lines = split.groupBy("capture_id", "row").agg(
        ordered.alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.sum(F.col("confidence") * F.length("text")) / size).alias("_confidence")
    )
    texts = lambda words: F.array_join(F.transform(words, lambda x: x["text"]), " ")
    parts = F.transform(F.sequence(F.lit(0), F.element_at("w", -1)["_segment"].cast("int")), lambda s: texts(F.filter("w", lambda x: x["_segment"] == s)))
    numbered = F.row_number().over(Window.partitionBy("capture_id").orderBy("y0", "x0", "row")) - 1
    return lines.select(
        "capture_id", numbered.alias("line_pos"), texts(F.col("w")).alias("text"), parts.alias("segments"),
        F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"))).alias("words"),
        "x0", "y0", "x1", "y1", F.round("_confidence", 1).alias("confidence"),
    )


def group_into_lines(words: DataFrame) -> DataFrame:
    return assemble_lines(assign_rows(words))


def word_height(words: Column, y0: Column, y1: Column) -> Column:
    """Upper median of the words' heights; the line's own without words."""
    heights = F.array_sort(F.transform(words, lambda w: w["y1"] - w["y0"]))
    return F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), y1 - y0)


def clean_text(words: Column) -> Column:
    """The words without artefacts: little confidence and two characters at most."""
    kept = F.filter(words, lambda w: ~((w["confidence"] < ARTEFACT_CONFIDENCE) & (F.length(F.regexp_replace(w["text"], "[^A-Za-z0-9_]", "")) <= 2)))
    return F.trim(F.array_join(F.transform(kept, lambda w: w["text"]), " "))
