import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ebbtide.core import table
from ebbtide.llm.secret_scan import RULES, Scanner

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept, told = docs, []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.checkpointed(stage(spark, kept, SF))
        told.append((name, made))
        if name != "packing":
            assert made.columns == docs.columns
        kept = made
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in told]
    assert names == ["language", "near duplicates", "decontamination", "secrets", "packing"]
    ids = [{r.doc_id for r in made.select("doc_id").collect()} for _, made in told]
    assert all(b <= a for a, b in zip([set(before), *ids], ids, strict=False)) and ids[3] == ids[2] == ids[4]
    assert len(ids[0]) > 0.95 * len(before) and len(ids[2]) > 0.3 * len(before)
    masked = {r.doc_id: r.text for r in told[3][1].collect()}
    spans = Scanner(RULES).scan([before[k] or "" for k in masked])
    assert all((masked[k] == before[k]) == (not s) for k, s in zip(masked, spans, strict=True))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids_of = {}
    for r in told[4][1].orderBy("doc_id", "start").collect():
        ids_of.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids_of == {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in masked.items()}


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and {"sequence_id", "offset", "ids_crc32"} <= set(rows.columns)


def test_stages_on_empty_and_odd_tables(spark):
    """No rows; nulls in every column, repeated rows, clashing extra columns."""
    docs = table(spark, SF, "documents")
    clash = "doc_id long, text string, lang string, source string, n_chars long, language string, _row int, overlap string, found_ string, chunk_ int, secrets string"
    known = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1, "x", "x", 1, "x") for r in docs.limit(120).collect()]
    odd = [(None, known[0][1], "en", *known[0][3:]), (9001, None, None, None, None, *known[0][5:]), (9002, "", *known[0][2:]), (9003, "12 34", *[None] * 9), known[1], known[1], (9004, known[2][1], *[None] * 9)]
    for rows in ([], known + odd):
        kept = spark.createDataFrame(rows, clash)
        columns = kept.columns
        for name, stage in corpus_pipeline.STAGES:
            made = corpus_pipeline.checkpointed(stage(spark, kept, SF))
            assert name == "packing" or made.columns == columns
            assert bool(rows) == bool(made.count())
            if name == "near duplicates":
                assert made.count() == made.select("text").distinct().count()
            kept = made
    for name, stage in corpus_pipeline.STAGES[1:]:  # what the first stage would have dropped
        made = stage(spark, spark.createDataFrame(odd, clash), SF)
        assert made.count() == (5 if name == "near duplicates" else made.count()) and (name == "packing" or made.columns == columns)
