"""Captures: files of recognised lines or images to pages, and pages to transactions.

Every source gives rows of TRANSACTION. `import_id` separates imports (users); `pos` is a row's place in its import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.dates import capture_day
from ebbtide.functions.text import normalize_label
from ebbtide.operators import pages as page_parsers

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE_JSON = f"text: string, segments: array<string>, words: array<struct<text:string,confidence:double,bbox:{_BOX}>>, bbox: {_BOX}, confidence: double"
TRANSACTION = (
    "import_id string, pos long, id string, raw_text string, label string, normalized_label string, amount_cents long, currency string, date date, date_is_approximate boolean, direction string, kind string, "
    "source string, capture_index int, ocr_confidence int, period_hint string, renewal_date date, trial_ends_at date"
)
MOST_ENTRIES = 1 << 20  # of a page, for pos


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files that are images by extension, or that have none: path, modificationTime, length, content."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).where(name.rlike(r"(?i)\.(png|jpe?g|webp|gif|bmp|heic|heif|avif|tiff?)$") | ~name.contains("."))


def lines_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a page, an array of lines: (capture_id, line_pos, ..., modified), read once; a line's place is its place in the array.

    A file that isn't such an array has one row, with `unreadable`; an empty array has none, nor has a file of no bytes, which
    Spark's readers pass over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    read = files.select(F.try_validate_utf8(F.col("content").cast("string")).alias("value"), F.col("_metadata.file_name").alias("file"), F.col("modificationTime").alias("modified"))
    page = F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.concat(F.lit('{"lines":'), "value", F.lit("}"))).otherwise("?"), f"lines array<struct<{LINE_JSON}>>, _corrupt_record string", {"mode": "PERMISSIVE"})
    told = read.select("file", "modified", page.alias("page")).withColumn("bad", F.col("page._corrupt_record").isNotNull() | F.col("page.lines").isNull())
    one = F.array(F.lit(None).cast(f"struct<{LINE_JSON}>"))
    lines = told.select("file", "modified", "bad", F.posexplode(F.when(F.col("bad"), one).otherwise(F.col("page.lines"))).alias("line_pos", "line"))
    return lines.select(
        F.regexp_replace("file", r"\.json$", "").alias("capture_id"), "line_pos", "line.text", "line.segments",
        F.transform("line.words", lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), *(w["bbox"][c].alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("words"),
        *(F.col(f"line.bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), "line.confidence", "modified", F.col("bad").alias("unreadable"),
    )


def dated(lines: DataFrame, now: Column) -> DataFrame:
    """lines with `reference`, the day of the capture."""
    return lines.withColumn("reference", capture_day(F.col("modified"), now))


def _as_transactions(rows: DataFrame, source: Column, entry: Column) -> DataFrame:
    place = F.col("capture_index").cast("long") * MOST_ENTRIES + entry
    named = rows.withColumns({"pos": place, "id": F.concat_ws(":", source, "capture_index", entry), "source": source, "currency": F.lit("EUR")})
    schema = T.StructType.fromDDL(TRANSACTION)
    return named.select(*((F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def bank_adapter(source: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Transactions of a bank's list. Transfers keep no text: it can name a person. Without a source, lines tell the kind of their page (`_kind`) and come dealt by page."""

    def adapt(lines: DataFrame) -> DataFrame:
        if source is None:
            entries = page_parsers.bank_entries(lines, ("import_id", "capture_index", "_kind"), dealt=True)
        else:
            entries = page_parsers.bank_entries(lines, ("import_id", "capture_index")).withColumn("_kind", F.lit(source))
        shown = lambda c: F.when(F.col("kind") == "transfer", "").otherwise(c)
        kind = F.when((F.col("kind") == "unknown") & (F.col("_kind") == page_parsers.DEBITS_KIND), "sepa").otherwise(F.col("kind"))
        rows = entries.where("capture_id is not null").select(
            "import_id", "capture_index", "entry", shown(F.col("raw_text")).alias("raw_text"), shown(F.col("label")).alias("label"), shown(normalize_label(F.col("label"))).alias("normalized_label"),
            F.col("cents").alias("amount_cents"), "date", F.col("approximate").alias("date_is_approximate"), "direction", kind.alias("kind"), F.col("confidence").alias("ocr_confidence"), F.col("_kind").alias("source"),
        )
        return _as_transactions(rows, F.col("source"), F.col("entry"))

    return adapt


def store_adapter(lines: DataFrame) -> DataFrame:
    """Transactions of a store's subscription page: debits without a date."""
    entries = page_parsers.parse_store(lines).join(lines.select("capture_id", "import_id", "capture_index").distinct(), "capture_id")
    rows = entries.select(
        "import_id", "capture_index", "entry", "raw_text", F.col("name").alias("label"), normalize_label(F.col("name")).alias("normalized_label"), F.col("price_cents").alias("amount_cents"),
        F.lit("debit").alias("direction"), F.lit("store").alias("kind"), F.col("confidence").alias("ocr_confidence"), F.col("period").alias("period_hint"), "renewal_date", "trial_ends_at",
    )
    return _as_transactions(rows, F.lit(page_parsers.STORE_KIND), F.col("entry"))


_read_bank = bank_adapter()
#: Page kind to adapter; add to it to read other kinds of page. Kinds that share an adapter are read in one pass.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {page_parsers.STORE_KIND: store_adapter, page_parsers.DEBITS_KIND: _read_bank, page_parsers.HISTORY_KIND: _read_bank}
#: (predicate over a frame of lines giving the captures it fits, rewrite) pairs that mend one bank's lines before parsing.
PROFILES: list[tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = []


def apply_profiles(lines: DataFrame, profiles=None) -> DataFrame:
    """Each capture's lines rewritten by the first profile that fits it; others stay as they are."""
    done, rest = None, lines
    for fits, rewrite in PROFILES if profiles is None else profiles:
        chosen = fits(rest).select("capture_id").distinct()
        part = rewrite(rest.join(chosen, "capture_id", "left_semi"))
        done = part if done is None else done.unionByName(part)
        rest = rest.join(chosen, "capture_id", "left_anti")
    return rest if done is None else done.unionByName(rest)


def transactions(lines: DataFrame, adapters=None, profiles=None) -> DataFrame:
    """Lines of captures (with import_id, capture_index, reference) to TRANSACTION rows, by the kind of each page.

    Pages of banks are classified and read where their lines were dealt to, in one pass. Store pages are a pass of their own,
    over the captures whose words allow them.
    """
    adapters = ADAPTERS if adapters is None else adapters
    profiles, out = PROFILES if profiles is None else profiles, None
    lines = lines.where("capture_id is not null")
    for adapt in dict.fromkeys(adapters.values()):
        kinds = [kind for kind, own in adapters.items() if own is adapt]
        asked = lines.join(page_parsers.maybe_store(lines), "capture_id", "left_semi") if kinds == [page_parsers.STORE_KIND] else lines
        known = page_parsers.with_kinds(asked).where(F.col("_kind").isin(*kinds))
        if profiles and page_parsers.STORE_KIND not in kinds:
            known = apply_profiles(known, profiles).repartition("capture_id")
        part = adapt(known)
        out = part if out is None else out.unionByName(part)
    return out
