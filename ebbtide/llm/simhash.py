"""SimHash near-duplicates by anchor-point covering.

A text is lower-cased (A-Z), split at ASCII white space and hashed as `width`-word shingles, repeats included; a bit of its
64-bit fingerprint is set where more than half the shingles' XXH64 values have it. Equal fingerprints are one class.

Classes link at `threshold` (2) or fewer differing bits. Of two such fingerprints, one half differs in at most one bit, and
of the other half, cut in three, one third not at all. The anchors of a half are the codewords of the [31,26] Hamming code
on its first 31 bits, a perfect code of covering radius 1: the fingerprint's own anchor is within 1, so its partner lies
within 1 + 1 of that anchor. Every fingerprint is replicated to all anchors within that radius (16 of 2**26 at most), for
each third of the other half beside that third's bits, and compared with those whose own anchor it is. So a place is one of
2**36 or more for each half and third, no pair within the threshold is missed, and candidates stay few up to some 10**9
distinct fingerprints. A fingerprint is replicated 96 times at most, however many are alike: equal ones are one class.

Edge cases: null, empty and blank texts have no shingle and fingerprint zero, linked like any other; fewer than `width`
words are one shingle. Repeated rows and null ids belong to their fingerprint's class; a component whose ids are all null
has a null component_id. A text of any length is hashed whole. An empty table gives no rows. Ties of a bit are 0. Other
columns are passed on (`keep_one`) or not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, table
from ebbtide.llm.graph import components
from ebbtide.llm.text import fresh, pieces

SEED, LENGTH = 42, 31


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str], width: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    hashes, sizes = [], []
    for text in texts:
        own = shingle_hashes(text, width)
        hashes += own
        sizes.append(len(own))
    h, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    out = np.zeros(len(texts), np.uint64)
    for bit in range(64 if len(starts) else 0):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [fingerprints(piece, width) for piece in pieces(batch, 2_000_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return computed.asNondeterministic()(text)


def _syndrome(word: Column) -> Column:
    """Which of the code's 31 places to flip to reach the nearest codeword, counted from 1; 0 on a codeword."""
    masks = [sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> k & 1) for k in range(5)]
    return sum((F.bit_count(word.bitwiseAND(m)) % 2) * (1 << k) for k, m in enumerate(masks))


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b), a < b: distinct fingerprints of prints(fp) that differ in at most `threshold` (2 at most) bits."""
    if threshold > 2:
        raise ValueError("the radius of the covering serves thresholds up to 2")
    first = (1 << LENGTH) - 1
    turned = [F.struct(F.lit(h).alias("half"), *(x.alias(n) for x, n in zip(pair, ("one", "other"), strict=True))) for h, pair in enumerate(((F.col("fp"), F.shiftrightunsigned("fp", 32)), (F.shiftrightunsigned("fp", 32), F.col("fp"))))]
    halves = prints.select("fp", F.explode(F.array(*turned)).alias("h")).select("fp", "h.half", F.col("h.one").bitwiseAND(first).alias("word"), "h.other")
    halves = halves.withColumn("s", _syndrome(F.col("word")).cast("int"))
    thirds = "transform(sequence(0, 2), k -> struct((half * 3 + k) as part, shiftright(other & 4294967295L, 11 * k) & 2047L as bits))"
    halves = halves.select("fp", "word", "s", F.explode(F.expr(thirds)).alias("t")).select("fp", "word", "s", "t.part", "t.bits")
    bit = "case when {p} = 0 then 0L else shiftleft(1L, {p} - 1) end"
    own = halves.select("part", "bits", F.col("fp").alias("a"), F.expr(f"word ^ {bit.format(p='s')}").alias("anchor"))
    near = f"transform(filter(sequence(1, {LENGTH}), p -> p = s or p < (p ^ s)), p -> word ^ {bit.format(p='p')} ^ {bit.format(p='(p ^ s)')})"
    ball = halves.select("part", "bits", F.col("fp").alias("b"), F.explode(F.expr(f"case when s = 0 then array(word) else {near} end")).alias("anchor"))
    return own.join(ball, ["part", "bits", "anchor"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def classes(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, root): each fingerprint that has a link, and the smallest of its component."""
    return components(links(prints, threshold)).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    rows = checkpointed(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = prints.join(classes(prints.select("fp"), threshold), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a column that names a row in every read: file and row of a table in files; of any other frame a number, written with its rows."""
    try:
        return docs.withColumn(row, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:  # a join, a union or an aggregate has no such column
        return checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, threshold: int = 2) -> DataFrame:
    """One document of each component (smallest id, then first row). docs may be any frame; it is written once unless it is a table in files."""
    row = fresh(docs, "_row")
    numbered = _numbered(docs, row)
    rows = checkpointed(numbered.select(F.col(row).alias("row"), F.col(key).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    prints = checkpointed(rows.groupBy("fp").agg(first.alias("first")))
    rooted = prints.join(classes(prints.select("fp"), threshold), "fp", "left")
    kept = rooted.groupBy(F.coalesce("root", "fp")).agg(F.min("first")["row"].alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
