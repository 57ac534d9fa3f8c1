r"""Approximate join of labels with a dictionary of services, of any size.

Works on distinct runs of words of distinct labels. Every candidate comes from an equality join:

- a variant within k edits of a run is cut into k + 1 pieces, of which k edits leave one whole, moved by no more letters than
  the edits before it or after it can move it. So a run asks for the pieces of its own text at those places, by word count,
  variant length and piece number, and no pair within the edits is missed;
- a word's beginnings are looked up on the glued spelling, whole labels on the compact one.

Edit distance (Spark's own, with a bound) sifts the candidates before Jaro-Winkler is asked, once for each pair of run and
variant. A dictionary of at most FEW variants (counted) is broadcast; a larger one is joined as Spark sees fit, and it may
split a frequent piece. The lengths and word counts of variants, which are broadcast, grow with the longest variant alone.

Null and empty labels match nothing. Ties: higher score, longer variant, dictionary order; intermediaries come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.core import broadcast_up_to, checkpointed
from ebbtide.functions.fuzzy import similarity
from ebbtide.functions.text import tokens

# The score a match needs, the lengths from which fuzzy and glued spellings are trusted, and their scores.
THRESHOLD = 0.92
LEAST_FUZZY, LEAST_GLUED = 5, 7
GLUED, COMPACT = 0.97, 0.99
FEW = 10_000  # variants, or services, that are broadcast


def variants(services: DataFrame) -> DataFrame:
    """A row for each variant, with the forms that are compared."""
    rows = services.select("service_ord", "service_id", "intermediary", F.posexplode("variants").alias("variant_ord", "variant")).withColumn("_t", tokens(F.col("variant")))
    text, compact = F.array_join("_t", " "), F.array_join("_t", "")
    edits = F.when(F.length(compact) >= LEAST_FUZZY, F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))).otherwise(0)
    return rows.select("service_ord", "service_id", "intermediary", "variant_ord", "variant", F.size("_t").alias("words"), text.alias("spelled"), compact.alias("compact"), edits.alias("edits"))


def _windows(of: Column, words: Column) -> Column:
    """Every run of that many words, joined by blanks; none if there are fewer."""
    starts = F.when(F.size(of) >= words, F.sequence(F.lit(1), F.size(of) - words + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(of, i, words), " "))


def _piece(i: Column, chars: Column, edits: Column) -> tuple[Column, Column]:
    """Where the piece i of edits + 1 begins in a variant of that many letters (from 0), and its length."""
    at = lambda j: F.floor(j * chars / (edits + 1)).cast("int")
    return at(i), at(i + 1) - at(i)


def _pieces(spelled: Column, edits: Column) -> Column:
    """array<struct<i, piece>>: a variant's text in edits + 1 pieces."""

    def cut(i: Column) -> Column:
        start, long = _piece(i, F.length(spelled), edits)
        return F.struct(i.alias("i"), F.substring(spelled, start + 1, long).alias("piece"))

    return F.transform(F.sequence(F.lit(0), edits), cut)


def _asked(run: Column, chars: Column, edits: Column) -> Column:
    """array<struct<i, piece>>: the pieces that a variant of that many letters within those edits can share with the run.

    Among the pieces left whole there is one with no more edits before it than pieces, and no more behind it: it begins within
    i letters of its own place, and within edits - i of its place counted from the end (Pass-Join's selection of substrings).
    """
    longer = F.length(run) - chars

    def cut(i: Column) -> Column:
        start, long = _piece(i, chars, edits)
        low = F.greatest(F.lit(0), start - i, start + longer - (edits - i))
        high = F.least(F.length(run) - long, start + i, start + longer + (edits - i))
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda at: F.struct(i.alias("i"), F.substring(run, at + 1, long).alias("piece"))))

    return F.flatten(F.transform(F.sequence(F.lit(0), edits), cut))


def near(runs: DataFrame, known: DataFrame) -> DataFrame:
    """(run, spelled, score) of distinct runs(run, words) and variants(words, spelled, edits) within their edits, each pair once."""
    texts = known.select("words", "spelled", "edits").distinct()
    fuzzy = texts.where("edits > 0").withColumn("chars", F.length("spelled"))
    shapes = F.broadcast(fuzzy.select("words", "chars", "edits").distinct())
    within = F.abs(F.length("run") - F.col("chars")) <= F.col("edits")
    asked = runs.join(shapes, "words").where(within).select("run", "words", "chars", F.inline(_asked(F.col("run"), F.col("chars"), F.col("edits"))))
    kept = fuzzy.select("spelled", "words", "chars", "edits", F.inline(_pieces(F.col("spelled"), F.col("edits"))))
    met = asked.join(kept, ["words", "chars", "i", "piece"]).where((F.col("run") != F.col("spelled")) & (F.levenshtein("run", "spelled") <= F.col("edits")))
    scored = met.select("run", "spelled").distinct().withColumn("score", similarity(F.col("run"), F.col("spelled")))
    same = runs.join(texts, (runs["run"] == texts["spelled"]) & (runs["words"] == texts["words"])).select("run", "spelled", F.lit(1.0).alias("score"))
    return scored.unionByName(same)


def scores(labels: DataFrame, services: DataFrame, label: str = "normalized_label", few: int = FEW) -> DataFrame:
    """(label, service_ord, ..., score): scores of each variant that comes near a label."""
    known = broadcast_up_to(checkpointed(variants(services)), few)
    plain = checkpointed(labels.select(F.col(label).alias("label")).where("label <> ''").distinct())
    spelled = plain.select("label", F.explode(F.array_distinct(F.array("label", F.replace("label", F.lit("RN"), F.lit("M"))))).alias("s")).select("label", tokens(F.col("s")).alias("t"))
    sizes = F.broadcast(known.select("words").distinct())
    runs = spelled.join(sizes, F.col("words") <= F.size("t")).select("label", "words", F.explode(F.array_distinct(_windows(F.col("t"), F.col("words")))).alias("run"))
    close = runs.join(near(runs.select("run", "words").distinct(), known), "run").join(known, ["spelled", "words"])
    lengths = F.broadcast(known.where(F.length("compact") >= LEAST_GLUED).select(F.length("compact").alias("chars")).distinct())
    starts = spelled.select("label", F.explode("t").alias("word")).join(lengths, F.length("word") >= F.col("chars")).select("label", F.expr("left(word, chars)").alias("compact")).distinct()
    glued = starts.join(known, "compact").where(F.length("compact") >= LEAST_GLUED).withColumn("score", F.lit(GLUED))
    whole = spelled.select("label", F.array_join("t", "").alias("compact")).join(known, "compact").where(F.length("compact") >= LEAST_FUZZY).withColumn("score", F.lit(COMPACT))
    kept = ["label", "service_ord", "service_id", "intermediary", "variant_ord", "variant", "score"]
    return close.select(kept).unionByName(glued.select(kept)).unionByName(whole.select(kept))


def match(labels: DataFrame, services: DataFrame, label: str = "normalized_label", threshold: float = THRESHOLD, few: int = FEW) -> DataFrame:
    """(label, service_id, score, variant, via): the best service and the best intermediary of each label that has one."""
    found = scores(labels, services, label, few)
    rank = F.struct((-F.col("score")).alias("worse"), (-F.length("variant")).alias("shorter"), "service_ord", "variant_ord", "service_id", "variant")
    best = found.groupBy("label").agg(
        F.min(F.when((F.col("score") >= threshold) & ~F.col("intermediary"), rank)).alias("own"),
        F.min(F.when((F.col("score") >= threshold) & F.col("intermediary"), rank)).alias("hidden"),
        F.min(F.when((F.col("score") >= THRESHOLD) & F.col("intermediary"), rank)).alias("via"),
    )
    chosen = F.coalesce("own", "hidden")
    return best.select("label", chosen["service_id"].alias("service_id"), (-chosen["worse"]).alias("score"), chosen["variant"].alias("variant"), F.col("via.service_id").alias("via")).where("service_id is not null or via is not null")
