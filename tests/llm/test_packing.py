import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    random.seed(2)
    bits = ["the", "THE", " ", "  ", "'s", "don't", "we'LL", "123", "4", "!?", "é", "É", "ñ", "ß", "µ", "\n", "\t", "🙂", "ſ", "K", "œ", "<|endoftext|>", "a" * 70, "中文", "́", "\x85", "\xa0", "\xad", "²", "½"]
    return ["".join(random.choices(bits, k=random.randrange(20))) for _ in range(700)] + ["", "word " * 9000]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read(), memory=50)
    for t in texts():
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_first_fit_decreasing():
    random.seed(4)
    for _ in range(40):
        capacity = random.randrange(5, 60)
        lengths = sorted((random.randrange(1, capacity + 1) for _ in range(random.randrange(1, 80))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), capacity)
        room, expected = [], []
        for n in lengths:
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            expected.append((k, capacity - room[k]))
            room[k] -= n
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == expected


@pytest.mark.parametrize("group_size", [16, 8192])
def test_pieces_round_trip(spark, group_size):
    rows = [(i, t, 1) for i, t in enumerate([*texts()[:150], "word " * 9000, None])] + [(3, texts()[3], 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    cut = packing.cut(df, PATH, with_ids=True)
    pieces = packing.pack(packing.checkpointed(cut), group_size=group_size).collect()
    library = Tokenizer.from_file(PATH)
    by = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 2048 and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        by.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    for k, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(by[k, len(want)])
        assert [x for _, ids in got for x in ids][: len(want)] == want or k == 3
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in sequences.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and sum(placed[-1]) <= 2048
    if group_size > 1000:  # small groups leave a sequence each half empty
        assert len(sequences) == -(-sum(p.length for p in pieces) // 2048)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0
