import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.core import crc_fold
from ebbtide.llm import language_id

WORDS = {"en": "the cat and dog with this that have from were said", "fr": "le chat et chien avec ceci que été où très déjà", "de": "der hund und katze mit dies dass über für nicht schön"}
DOCS = "doc_id long, text string, lang string, source string, language string"


@pytest.fixture(scope="module")
def docs(spark):
    random = np.random.default_rng(1)
    rows = [(i, " ".join(random.choice(WORDS[x].split(), 12)), x, "s", "clash") for i, x in enumerate(random.choice(list(WORDS), 600).tolist())]
    edges = [(1001, None, "en", "s", "c"), (1002, "", "en", "s", "c"), (1003, "12 34 !?", "fr", "s", "c"), (None, "the cat and dog", "en", "s", "c"), (7, rows[7][1], rows[7][2], "s", "c"), (1004, "the cat " * 30_000, None, "s", "c"), (1005, "le chat été", None, None, None)]
    return spark.createDataFrame(rows + edges, DOCS)


def test_held_out_accuracy_and_edges(docs):
    judged = language_id.identify(docs)
    told = judged.select("doc_id", "lang", crc_fold(F.col("doc_id"), 5).alias("fold"), f"{judged.columns[-1]}.*").collect()
    assert len(told) == docs.count()
    held = [r for r in told if r.fold == 0 and r.doc_id < 1000]
    assert len(held) > 80 and all(r.lang_pred == r.lang for r in held)
    by = {r.doc_id: r for r in told}
    for k in (1001, 1002, 1003):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert (by[1004].lang_pred, by[1005].lang_pred, by[None].lang_pred) == ("en", "fr", "en")
    assert all(0 <= r.score <= 1 for r in told)


def letters_of(text):
    """Lower-cased letters as UTF-16 units, a blank for each run of others, three blanks before and one after."""
    out = []
    for c in text.lower() + " ":
        if c.isalpha():
            unit = c.encode("utf-16-le")
            out += [int.from_bytes(unit[i : i + 2], "little") for i in range(0, len(unit), 2)]
        elif not out or out[-1]:
            out.append(0)
    return [0, 0, 0, *(out[1:] if out[:1] == [0] else out)]


class Brute:
    """Interpolated Kneser-Ney of one language, by dictionaries."""

    def __init__(self, texts, floor):
        full = Counter(tuple(x[i : i + 4]) for x in map(letters_of, texts) for i in range(len(x) - 3))
        self.levels = [full]
        for _ in range(3):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.floor, self.cut, self.total, self.kept = floor, [], [], []
        for level in self.levels:
            many = Counter(level.values())
            cut = many[1] / (many[1] + 2 * many[2]) if many[1] and many[2] else 0.5
            total, kept = Counter(), Counter()
            for g, n in level.items():
                total[g[:-1]] += n
                kept[g[:-1]] += n - min(cut, n)
            self.cut.append(cut)
            self.total.append(total)
            self.kept.append(kept)

    def p(self, gram):
        p = self.floor
        for k in range(4):
            own = gram[3 - k :]
            total = self.total[k].get(own[:-1])
            if total:
                seen = self.levels[k].get(own, 0)
                p = max(seen - self.cut[k], 0) / total + max(1 - self.kept[k][own[:-1]] / total, 1e-9) * p
        return p

    def bits(self, text):
        x = letters_of(text)
        return -sum(math.log2(self.p(tuple(x[i : i + 4]))) for i in range(len(x) - 3)) / (len(x) - 3)


def models(rows):
    """Brute-force models of (text, lang), as rows of folds 2 to 4 teach them."""
    by = {lang: [t for t, x in rows if x == lang] for lang in sorted({x for _, x in rows})}
    floor = 1 / (len({c for t, _ in rows for c in letters_of(t)}) + 1)
    return {lang: Brute(texts, floor) for lang, texts in by.items()}


def test_scores_are_those_of_brute_force(docs, spark):
    """Every text's bits a character and language, with letters beyond U+FFFF and unseen ones."""
    more = spark.createDataFrame([(2000 + i, t, x) for i, (t, x) in enumerate([("𐐀𐐩𐐪𐐫 𐐬𐐭 𐐀𐐩𐐪", "xx"), ("한국어 말 漢字", "xx"), ("quixotic zephyr жщ", None), ("ß", None), ("été " * 300, None)] * 4)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(more).withColumn("fold", crc_fold(F.col("doc_id"), 5))
    rows = both.collect()
    brute = models([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and (r.fold or 0) > 1])
    told = language_id.identify(both).select("text", "language.*").collect()
    assert len(told) == len(rows)
    for r in told:
        if r.text is None or not any(c.isalpha() for c in r.text) or len(r.text) > 10_000:
            continue
        bits = {lang: m.bits(r.text) for lang, m in brute.items()}
        assert abs(r.bits_per_char - min(bits.values())) < 1e-4 and bits[r.lang_pred] - min(bits.values()) < 1e-4


def test_probabilities_sum_to_one(docs):
    rows = [(r.text, r.lang) for r in docs.collect() if r.text and r.lang]
    brute = models(rows)
    counted = language_id.count(docs.where("text <> ''").select("text", "lang").where("lang is not null"))
    langs, floor, entries = language_id.learn(counted)
    units = sorted({c for t, _ in rows for c in letters_of(t)})
    for context in ("   ", " th", "cha", "zzz"):
        grams = [letters_of(context)[-4:-1] + [u] if context.strip() else [0, 0, 0, u] for u in units]
        codes = [sum(c << (16 * (3 - i)) for i, c in enumerate(g)) for g in grams]
        scores = {r.gram: r.scores for r in language_id.gram_scores(docs.sparkSession.createDataFrame([(c,) for c in codes], "gram long"), langs, floor, entries).collect()}
        for j, lang in enumerate(langs):
            p = [2 ** scores[c][j] for c in codes]
            assert 1 - 2 * 2**floor - 1e-5 <= sum(p) <= 1 + 1e-5  # the rest is for letters never seen
            assert all(abs(x - brute[lang].p(tuple(g))) < 1e-5 for x, g in zip(p, grams, strict=True))


def test_wrong_script_is_rejected(docs, spark):
    odd = spark.createDataFrame([(3000, "жщ ыъэ юящ фхц чшщ ъыь эюя " * 20, None), (3001, "the cat and dog said " * 10, None)], "doc_id long, text string, lang string")
    told = {r.doc_id: r.rejected for r in language_id.identify(docs.select("doc_id", "text", "lang").union(odd)).select("doc_id", "language.rejected").collect()}
    assert told[3000] and not told[3001]


def test_nothing_to_learn_and_empty_table(docs):
    alone = docs.withColumn("lang", F.lit(None).cast("string"))
    judged = language_id.identify(alone)
    assert {r[0] for r in judged.select(f"{judged.columns[-1]}.lang_pred").collect()} == {"und"}
    assert language_id.keep_identified(docs.where("false")).count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_no_gram_is_dropped_and_chunks_and_blocks_change_nothing(docs, spark, monkeypatch):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    random = np.random.default_rng(2)
    crowd = [(5000 + i, "".join(random.choice(letters, 10_000)), "zz") for i in range(120)]
    both = docs.where("doc_id < 1000").select("doc_id", "text", "lang").union(spark.createDataFrame([*crowd, (9002, "quixotic", "en")], "doc_id long, text string, lang string"))
    counted = language_id.count(language_id._training(both, "text", "lang", "doc_id"))
    learnt = [r[1] for r in crowd if zlib.crc32(str(r[0]).encode()) % 5 > 1]
    assert counted.where("lang = 'zz'").count() == len({g for t in learnt for x in [letters_of(t)] for g in zip(x, x[1:], x[2:], x[3:])}) > 600_000
    some = both.where("doc_id < 5010 or doc_id >= 9000")
    whole = {r.doc_id: r.language for r in language_id.identify(some).collect()}
    monkeypatch.setattr(language_id, "CHUNK", 5000)
    monkeypatch.setattr(language_id, "GRAMS", 1000)
    for r in language_id.identify(some).collect():
        assert r.language.lang_pred == whole[r.doc_id].lang_pred and abs(r.language.bits_per_char - whole[r.doc_id].bits_per_char) < 1e-6


@pytest.mark.parametrize("odd", ["en", "es"])
def test_an_unlearned_language_in_latin_letters_is_rejected(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("lang") != odd, F.col("lang")).alias("lang"))
    told = language_id.identify(docs).select("lang", "language.rejected", "language.n_chars", crc_fold(F.col("doc_id"), 5).alias("fold")).where("n_chars > 0").collect()
    foreign, own = [r.rejected for r in told if r.lang is None], [r.rejected for r in told if r.lang and r.fold == 0]
    print(odd, "accepted", foreign.count(False), "of", len(foreign), "own rejected", own.count(True), "of", len(own))
    assert sum(foreign) > 0.9 * len(foreign) and sum(own) < 0.1 * len(own)


def test_columns_of_any_type_are_passed_on(docs, spark):
    nested = docs.select("doc_id", "text", "lang").withColumns({"a": F.array(F.create_map(F.lit("k"), F.lit(1))), "b": F.struct(F.create_map(F.lit(1), F.lit("v")).alias("m"), F.lit(2).alias("n")), "chunk_": F.lit(1.5), "language": F.lit("x")})
    judged = language_id.identify(nested)
    assert judged.columns == [*nested.columns, "language_"] and judged.count() == docs.count()
    assert {(r.a[0]["k"], r.b.m[1], r.chunk_, r.language) for r in judged.collect()} == {(1, "v", 1.5, "x")}


def test_limits_are_drawn_towards_the_common_one(spark):
    """Few texts of a language move its limit a little, many nearly all the way; none leave the common one."""
    rows = []
    for lang, many, own, foreign in (("aa", 400, 2.0, 4.0), ("bb", 5, 2.0, 8.0), ("cc", 0, 0.0, 0.0)):
        i = ["aa", "bb", "cc"].index(lang)
        for k in range(many):
            rows.append((lang, [own if j == i else 9.0 for j in range(3)], 10_000, True))
            rows.append((["bb", "aa"][i], [foreign if j == i else 2.0 if j == 1 - i else 9.5 for j in range(3)], 10_000, True))
    model = language_id.Model(["aa", "bb", "cc"], floor=np.zeros(3))
    language_id._limits(model, spark.createDataFrame(rows, "lang string, bits array<double>, n long, lettered boolean"))
    spread = model.limits - model.usual
    assert np.isfinite(model.limits).all() and abs(spread[0] - spread[2]) < 0.1 and spread[2] < spread[1]
