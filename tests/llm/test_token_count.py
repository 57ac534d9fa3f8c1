import json
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(DEFINITION)
MACHINE = token_count.Compiled(DEFINITION, lexicon_size=400)
BITS = ["a", "B", "1", "22", " ", "  ", "   ", "\n", "\t", "\r\n", "'", "'s", "'S", "'re", "'r", "'ve", "'v", "'ll", "'l", "'m", "'d", "e", "l", "!", "?!", "é", "中", "٣", "²", "½", "\xa0", " ", "\x85", "🙂", "_", "<|endoftext|>", "<|endof", "ſ", "́"]


def true(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    random.seed(11)
    texts = ["".join(random.choices(BITS, k=random.randrange(25))) for _ in range(4000)] + ["", "word " * 20_000, " " * 5000, "'" * 1000]
    assert MACHINE.count(texts).tolist() == [true(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert MACHINE.count(texts).tolist() == [true(t) for t in texts]


def test_no_count_comes_from_the_library_and_forgetting_changes_nothing(monkeypatch):
    """The merges alone, with room for 50 compiled moves, over words of the driver's documents and of random letters."""
    import duckdb

    random.seed(2)
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null").fetchall()]
    words = [w.replace("Ġ", " ") for t in texts for w, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(t)]
    words = [w for w in dict.fromkeys(words) if w.isascii()][:3000] + ["".join(random.choices("aeinrst", k=random.randrange(1, 60))) for _ in range(2000)] + ["na" * 20_000]
    small = token_count.Merges(json.loads(DEFINITION)["model"]["merges"], size=50)
    want = [len(e.ids) for e in LIBRARY.encode_batch(words, add_special_tokens=False)]
    assert [MACHINE.merges.count(w.encode()) for w in words] == want
    assert [small.count(w.encode()) for w in words[:500]] == want[:500]
    machine = token_count.Compiled(DEFINITION)
    monkeypatch.setattr(machine, "library", None)  # classes of these characters are known
    assert machine.count(words[:100]).tolist() == want[:100]


def test_chunks_change_nothing():
    random.seed(5)
    kinds = np.array(random.choices(range(12), k=3000), np.uint8)
    tables = token_count.compiled()
    whole = token_count.token_starts(kinds, tables, 4096)
    for chunk in (1, 2, 7, 256):
        assert (token_count.token_starts(kinds, tables, chunk) == whole).all()


def test_frames(spark):
    rows = [(1, "héllo world", 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, "x " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    told = token_count.count_tokens(df, PATH).select("text", "tokens_.*").collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in told) == sorted((len((t or "").encode()), true(t or ""), true(t or "") > 1024) for _, t, _ in rows)
    assert token_count.count_tokens(df.where("false"), PATH).count() == 0
