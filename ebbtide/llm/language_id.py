"""Language identification by interpolated Kneser-Ney character language models.

A text is lower-cased; every run of non-letters is one blank; letters are UTF-16 code units of 16 bits (a letter beyond
U+FFFF is two), so a 4-gram of any alphabet is one 64-bit integer. Spark counts the 4-grams of every training text, derives
the continuation counts of the lower orders from the distinct 4-grams and estimates every counted gram and context: the
model is a table (kind, code, language, log2 value), nothing of it is dropped and nothing bounds it.

The distinct 4-grams of all texts are dealt to blocks of about GRAMS; a block names the entries it can ask for, a shuffled
join answers, and the block is scored by binary search in sorted arrays of its slice of the model. Texts are dealt by hash
to chunks of about CHUNK characters, shuffled once; a chunk names its 4-grams, a join brings their scores, and the texts are
scored by binary search in them. So a task's memory follows its chunk and not the model, and the driver holds no model.

Rows whose id falls in fold 0 of 5 are never learnt from. Folds 2 to 4 give the counts, fold 1 the rejection limits.

Edge cases: null texts and texts without a letter are `und`, score 0, rejected. No usable training row: all are `und`.
Rows with a null id are predicted but never learnt from. Equal cross-entropies: the first language by name. Repeated rows
are counted and judged as often as they occur. A text of any length is scored whole, in the chunk it falls in. An empty
table gives no rows. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.core import checkpointed, crc_fold, table
from ebbtide.llm.text import fresh, pieces

ORDER, BITS = 4, 16
CHUNK, GRAMS = 8_000_000, 65_536
PRIOR = 20  # texts
UND = "und"
RESULT = "lang_pred string, score double, bits_per_char double, n_chars long, rejected boolean"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _part(gram: np.ndarray, order: int) -> np.ndarray:
    """The last `order` letters of unsigned grams."""
    return gram & np.uint64((1 << (BITS * order)) - 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram (unsigned) ending at every letter and blank, and the index of its text."""
    lowered = [f"   {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[points], points, 0)
    starts = np.cumsum(sizes) - sizes
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    for k in range(ORDER - 1):
        keep[starts + k] = True
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    codes = codes[keep].astype(np.uint64)
    wide = codes > 0xFFFF
    if wide.any():
        at = np.flatnonzero(wide)
        high, low = 0xD7C0 + (codes[at] >> np.uint64(10)), 0xDC00 + (codes[at] & np.uint64(0x3FF))
        codes[at] = high
        codes, owner = np.insert(codes, at + 1, low), np.insert(owner, at + 1, owner[at])
    gram = codes.copy()
    for k in range(1, ORDER):
        gram[k:] |= codes[:-k] << np.uint64(BITS * k)
    whole = np.ones(len(codes), bool)
    first = np.searchsorted(owner, np.arange(len(texts)))
    for k in range(ORDER - 1):
        whole[first + k] = False
    return gram[whole], owner[whole]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial 4-gram counts of each language (of no language for texts that are not learnt from), merged within the task before they are sent."""
    held: dict[str, pd.Series] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang", dropna=False).text:
            lang = lang if isinstance(lang, str) else None
            for piece in pieces(texts, 1_000_000):
                code, unique = pd.factorize(grams(piece)[0])
                part = pd.Series(np.bincount(code, minlength=len(unique)), index=unique)
                held[lang] = part if lang not in held else held[lang].add(part, fill_value=0)
            if lang in held and len(held[lang]) > 1_000_000:
                yield _rows(lang, held.pop(lang))
    for lang, part in held.items():
        yield _rows(lang, part)


def _rows(lang: str | None, part: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"lang": pd.Series([lang] * len(part), dtype=object), "gram": part.index.to_numpy(np.uint64).view(np.int64), "cnt": part.to_numpy().astype(np.int64)})


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # of each order: sorted gram codes,
    logp: list[np.ndarray] = field(default_factory=list)  # their log2 probability in each language, NaN where unseen,
    contexts: list[np.ndarray] = field(default_factory=list)  # sorted context codes
    backoff: list[np.ndarray] = field(default_factory=list)  # and their log2 back-off weight in each language, 0 where unseen
    floor: np.ndarray | None = None
    limits: np.ndarray | None = None  # bits a character from which a text of the language is rejected
    usual: np.ndarray | None = None

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of the last character of each gram, by language."""
        total = np.repeat(self.floor[None, :], len(gram), axis=0)
        for k in range(1, ORDER + 1):
            part = _part(gram, k)
            at, hit = _find(self.contexts[k - 1], part >> np.uint64(BITS))
            total[hit] += self.backoff[k - 1][at[hit]]
            at, hit = _find(self.keys[k - 1], part)
            seen = self.logp[k - 1][at[hit]]
            total[hit] = np.where(np.isnan(seen), total[hit], seen)
        return total

    def verdict(self, mean: np.ndarray, n: np.ndarray, lettered: np.ndarray) -> pd.DataFrame:
        best = mean.argmin(axis=1)
        lead = (mean - mean.min(axis=1)[:, None]) * np.minimum(n, 50)[:, None]
        score = 1 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)
        least = mean.min(axis=1)
        out = pd.DataFrame({"lang_pred": np.array(self.langs, object)[best], "score": score, "bits_per_char": least, "n_chars": n})
        if self.limits is None:
            out["rejected"] = ~lettered
        else:  # short texts are drawn to the language's usual value, as 20 characters of it would do
            drawn = (least * n + 20 * self.usual[best]) / (n + 20)
            out["rejected"] = ~lettered | (drawn > self.limits[best])
        out.loc[~lettered, ["lang_pred", "score", "bits_per_char", "n_chars"]] = [UND, 0.0, 0.0, 0]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def _needed(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and code of the entries that scoring the grams can ask for: kind k is a gram of that order, ORDER + k the context of one."""
    kinds, codes = [], []
    for k in range(1, ORDER + 1):
        part = np.unique(_part(gram, k))
        for kind, code in ((k, part), (ORDER + k, np.unique(part >> np.uint64(BITS)))):
            kinds.append(np.full(len(code), kind, np.int32))
            codes.append(code.view(np.int64))
    return np.concatenate(kinds), np.concatenate(codes)


def _model(langs: list[str], floor: float, kind: np.ndarray, code: np.ndarray, at: np.ndarray, value: np.ndarray) -> Model:
    """The Model of some entries; `at` is the language's place."""
    model, code = Model(langs, floor=np.full(len(langs), floor)), code.view(np.uint64)
    for k in range(1, ORDER + 1):
        for own, keys, values, blank in ((kind == k, model.keys, model.logp, np.nan), (kind == ORDER + k, model.contexts, model.backoff, 0)):
            unique, place = np.unique(code[own], return_inverse=True)
            wide = np.full((len(unique), len(langs)), blank, np.float32)
            wide[place, at[own]] = value[own]
            keys.append(unique)
            values.append(wide)
    return model


def count(rows: DataFrame) -> DataFrame:
    """(lang, gram, cnt) of rows (text, lang); texts without lang are counted under none."""
    return checkpointed(rows.select("lang", "text").mapInPandas(_counts, "lang string, gram long, cnt long").groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")))


def learn(counted: DataFrame) -> tuple[list[str], float, DataFrame | None]:
    """Languages, floor and entries (kind, code, at, value) of a model of counted 4-grams."""
    level = counted.where("lang is not null")
    levels = [level]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before the gram
        level = checkpointed(level.groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count("*").alias("cnt")))
        levels.insert(0, level)
    langs = sorted(r.lang for r in levels[0].select("lang").distinct().collect())
    if not langs:
        return [], 0.0, None
    floor = -float(np.log2(levels[0].select("gram").distinct().count() + 1))  # every letter of any language alike, and one for all others
    lower, parts = None, []
    for k, level in enumerate(levels, 1):
        few = {(r.lang, r.cnt): r.n for r in level.where("cnt <= 2").groupBy("lang", "cnt").agg(F.count("*").alias("n")).collect()}
        told = []
        for i, x in enumerate(langs):
            once, twice = few.get((x, 1), 0), few.get((x, 2), 0)
            told.append((x, i, once / (once + 2 * twice) if once and twice else 0.5))
        context = Window.partitionBy("at", "ctx")  # 65,536 rows at most, one for each letter
        own = (
            level.join(F.broadcast(level.sparkSession.createDataFrame(told, "lang string, at int, cut double")), "lang").withColumn("ctx", F.shiftrightunsigned("gram", BITS))
            .withColumn("own", F.greatest(F.col("cnt") - F.col("cut"), F.lit(0.0)) / F.sum("cnt").over(context))
            .withColumn("weight", F.greatest(1 - F.sum("own").over(context), F.lit(1e-9)))
            .withColumn("short", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1))
        )
        own = own.withColumn("less", F.lit(2.0**floor)) if lower is None else own.join(lower, ["at", "short"])  # whose gram is seen, its end is
        own = checkpointed(own.select("at", "gram", "ctx", "weight", (F.col("own") + F.col("weight") * F.col("less")).alias("p")))
        lower = own.select("at", F.col("gram").alias("short"), F.col("p").alias("less"))
        parts.append(own.select(F.lit(k).alias("kind"), F.col("gram").alias("code"), "at", F.log2("p").cast("float").alias("value")))
        parts.append(own.groupBy("at", "ctx").agg(F.max("weight").alias("weight")).select(F.lit(ORDER + k).alias("kind"), F.col("ctx").alias("code"), "at", F.log2("weight").cast("float").alias("value")))
    return langs, floor, reduce(DataFrame.union, parts)


def gram_scores(distinct: DataFrame, langs: list[str], floor: float, entries: DataFrame) -> DataFrame:
    """(gram, scores) of distinct grams: the log2 probability of the last character in each language."""
    blocks = 1 + distinct.count() // GRAMS
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks))).repartition("block")

    def ask(group: pa.Table) -> pa.Table:
        kind, code = _needed(group["gram"].to_numpy().view(np.uint64))
        return pa.table({"block": pa.array(np.full(len(kind), group["block"][0].as_py())), "kind": pa.array(kind), "code": pa.array(code)})

    def answer(group: pa.Table, found: pa.Table) -> pa.Table:
        model = _model(langs, floor, *(found[c].to_numpy() for c in ("kind", "code", "at", "value")))
        scores = model.score(group["gram"].to_numpy().view(np.uint64)).astype(np.float32)
        ends = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * len(langs))
        return pa.table({"gram": group["gram"], "scores": pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))})

    slices = dealt.groupBy("block").applyInArrow(ask, "block long, kind int, code long").join(entries, ["kind", "code"])
    return checkpointed(dealt.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(answer, "gram long, scores array<float>"))


def _training(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """(text, lang) of all texts; lang is null for those that give no counts: fold 0, fold 1 and rows without id."""
    counts = crc_fold(F.col(key), 5) > 1
    return docs.select(F.col(text).alias("text"), F.when(counts, F.col(lang).cast("string")).alias("lang")).where("text is not null")


def _threshold(own: dict[int, int], foreign: dict[int, int], false_rejects: float) -> float:
    """The bin edge with the least sum of the shares of own bins above it and foreign bins below it; of equal ones the middle.

    Without foreign texts, the edge that all but `false_rejects` of the own ones stay below.
    """
    edges = np.arange(min([*own, *foreign]), max([*own, *foreign]) + 2)
    above = np.array([sum(n for b, n in own.items() if b >= e) for e in edges]) / max(sum(own.values()), 1)
    below = np.array([sum(n for b, n in foreign.items() if b < e) for e in edges]) / max(sum(foreign.values()), 1)
    if not foreign:
        return float(edges[np.flatnonzero(above <= false_rejects)[0]])
    cost = above + below
    return float(np.median(edges[cost <= cost.min() + 1e-12]))


def _limits(model: Model, scored: DataFrame, false_rejects: float = 0.001) -> None:
    """Set the model's limits by the calibration texts (lang, bits, n, lettered).

    A language's own texts are those of it that are predicted so; foreign to it are the texts of each other language that
    would go to it if their own language had not been learnt. A limit is drawn between the two. Bits are compared as
    excess over the language's usual value, in bins of a hundredth, so what reaches the driver is bounded by the
    languages. Each limit is drawn towards that of all languages together, with the weight of PRIOR texts.
    """
    if not model.langs:
        return
    index = F.create_map(*(x for i, lang in enumerate(model.langs) for x in (F.lit(lang), F.lit(i))))
    told = scored.where("lettered").select(index[F.col("lang")].alias("mine"), "n", "bits").where("mine is not null")
    told = told.withColumn("best", F.array_position("bits", F.array_min("bits")).cast("int") - 1)
    without = F.transform("bits", lambda x, i: F.when(i != F.col("mine"), x))
    own = told.where("best = mine").select(F.col("mine").alias("at"), F.lit(True).alias("own"), "n", F.array_min("bits").alias("b"))
    other = told.withColumn("_rest", without).select((F.array_position("_rest", F.array_min("_rest")).cast("int") - 1).alias("at"), F.lit(False).alias("own"), "n", F.array_min("_rest").alias("b")).where("b is not null")
    usual = {r["at"]: r.usual for r in own.groupBy("at").agg(F.avg("b").alias("usual")).collect()}
    if not usual:  # nothing to calibrate by
        model.usual, model.limits = np.zeros(len(model.langs)), np.full(len(model.langs), np.inf)
        return
    model.usual = np.array([usual.get(i, np.mean(list(usual.values()))) for i in range(len(model.langs))])
    drawn = (F.col("b") - F.array(*map(F.lit, model.usual.tolist()))[F.col("at")]) * F.col("n") / (F.col("n") + 20)
    bins = own.union(other).groupBy("at", "own", F.floor(100 * drawn).cast("int").alias("bin")).agg(F.count("*").alias("many")).collect()
    held: list[tuple[Counter, Counter]] = [(Counter(), Counter()) for _ in range(len(model.langs) + 1)]
    for r in bins:
        for i in (r["at"], -1):
            held[i][not r.own][r.bin] += r.many
    pooled, limits = _threshold(*held[-1], false_rejects), []
    for pair in held[:-1]:
        many = min(sum(x.values()) for x in pair)
        limits.append((many * (_threshold(*pair, false_rejects) if many else 0) + PRIOR * pooled) / (many + PRIOR) / 100)
    model.limits = model.usual + np.array(limits)


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of this type: not those that hold a map or a variant."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _packed(text: Column) -> Column:
    """Each text compressed; null stays null."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if t is None else pack(t.encode()) for t in texts.to_pylist()], pa.binary())

    return packed(text)


def _unpacked(packed: pa.ChunkedArray) -> list[str | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if x is None else unpack(x).decode() for x in packed.to_pylist()]


def _scored(docs: DataFrame, langs: list[str], scores: DataFrame, kept: list[str], text: str, names: list[str]) -> DataFrame:
    """Columns `kept` of docs, then `names`: bits a character by language, characters, whether there is a letter."""
    chunk, bits, n, lettered = names
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    named = F.pmod(F.xxhash64(*(f.name for f in docs.schema if _hashable(f.dataType))), F.lit(1 + total // CHUNK))
    numbered = docs.withColumn(chunk, named)
    read = pa.ChunkedArray.to_pylist
    if text not in kept:  # texts that only the scores need travel compressed
        numbered, read = numbered.withColumn(text, _packed(F.col(text))), _unpacked
    dealt = numbered.repartition(chunk)  # the one shuffle of texts, which both uses below share

    def ask(group: pa.Table) -> pa.Table:
        own = np.unique(np.concatenate([np.unique(grams(piece)[0]) for piece in pieces(read(group[text]), 1_000_000)])).view(np.int64)
        return pa.table({chunk: pa.array(np.full(len(own), group[chunk][0].as_py())), "gram": pa.array(own)})

    def answer(group: pa.Table, found: pa.Table) -> pa.Table:
        keys = found["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, values = keys[order], found["scores"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))[order]
        means, counts, letter = [np.zeros((0, len(langs)))], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for piece in pieces(read(group[text]), 1_000_000):
            gram, owner = grams(piece)
            at, size = np.searchsorted(keys, gram), len(piece)
            many = np.bincount(owner, minlength=size)
            sums = np.stack([np.bincount(owner, values[at, j], size) for j in range(len(langs))], axis=1)
            means.append(-sums / np.maximum(many, 1)[:, None])
            counts.append(many.astype(np.int64))
            letter.append(np.bincount(owner[_part(gram, 1) > 0], minlength=size) > 0)
        mean = np.concatenate(means)
        ends = pa.array(np.arange(len(mean) + 1, dtype=np.int32) * len(langs))
        return group.select(kept).append_column(bits, pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))).append_column(n, pa.array(np.concatenate(counts))).append_column(lettered, pa.array(np.concatenate(letter)))

    slices = dealt.groupBy(chunk).applyInArrow(ask, f"`{chunk}` long, gram long").join(scores, "gram")
    made = docs.select(*kept).schema
    for name, kind in ((bits, "array<double>"), (n, "long"), (lettered, "boolean")):
        made = T.StructType([*made.fields, T.StructField(name, T._parse_datatype_string(kind))])
    return dealt.groupBy(chunk).cogroup(slices.groupBy(chunk)).applyInArrow(answer, made)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", kept: list[str] | None = None) -> DataFrame:
    """docs (or its columns `kept`, which include lang and key) with a struct column `language` (or a longer name, if docs has that one) fitted on docs itself."""
    kept, name = kept or docs.columns, fresh(docs, "language")
    counted = count(_training(docs, text, lang, key))
    langs, floor, entries = learn(counted)
    if not langs:
        none = F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_char"), F.lit(0).cast("long").alias("n_chars"), F.lit(True).alias("rejected"))
        return docs.select(*kept).withColumn(name, none)
    model = Model(langs, floor=np.full(len(langs), floor))
    names = [fresh(docs, x) for x in ("chunk_", "bits_", "n_", "lettered_")]
    scores = gram_scores(counted.select("gram").distinct(), langs, floor, entries)
    scored = checkpointed(_scored(docs, langs, scores, kept, text, names))

    def judged(model: Model) -> Column:
        @F.pandas_udf(RESULT)
        def verdict(bits: pd.Series, n: pd.Series, lettered: pd.Series) -> pd.DataFrame:
            return model.verdict(np.stack(bits), n.to_numpy(), lettered.to_numpy(bool)) if len(bits) else pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})

        return verdict(*names[1:])

    _limits(model, scored.where((crc_fold(F.col(key), 5) == 1) & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), *(F.col(c).alias(x) for c, x in zip(names[1:], ("bits", "n", "lettered"), strict=True))))
    return scored.withColumn(name, judged(model)).select(*kept, name)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that are not rejected, with the columns they came with."""
    judged = identify(docs)
    return judged.where(~F.col(judged.columns[-1])["rejected"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), kept=["doc_id", "lang"])
    return docs.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_char", "language.rejected")
