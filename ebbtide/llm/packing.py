"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, inside randomised groups of pieces.

Each document is tokenized and closed with an end id, then cut at every `capacity` ids; what is left over is a shorter
piece. Only the pieces' lengths and checksums are shuffled. The pieces are dealt at random (seeded, over checkpointed
rows) to groups of about `group_size`, so no key, source or group of copies can fill a group, and every group is packed
on its own: longest piece first, into the first bin that has room, found in logarithmic time in a tree whose inner nodes
hold the largest capacity below them.

Edge cases: null text is empty: one piece, the end id. Rows with equal or null ids are packed like any others; ids may be
numbers or texts. An empty table gives no rows. Equal lengths go by doc_id, then start. A text of any length is encoded
whole, then cut. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.core import checkpointed, table

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit values.

    The splitter and BPE treat each word alone, so words are encoded once and remembered (in a memory of bounded size).
    Texts with characters beyond Latin-1, where lower-casing or composition could depend on the neighbours, and texts that
    hold a special token are given to the library whole.
    """

    def __init__(self, definition: str, memory: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        plain = [chr(c) for c in range(256)]

        def run(lead: str) -> str:  # the plain characters that the splitter puts in one word with `lead`
            found = {at[0]: at[1] for _, at in self.library.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{c}\n\n" for c in plain))}
            return re.escape("".join(c for i, c in enumerate(plain) if found.get(4 * i) == 4 * i + 2))

        letters, others = run("a"), run("!")
        alone = {at[0] for _, at in self.library.pre_tokenizer.pre_tokenize_str("".join(f"a{c}\n\n" for c in plain))}
        single = re.escape("".join(c for i, c in enumerate(plain) if 4 * i + 1 in alone and not re.match(f"[{others}]", c)))
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{single}]|[{others}]+".encode("latin-1"))
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.memory = memory

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        try:
            words = self.word.findall(text.lower().encode("latin-1"))
        except UnicodeEncodeError:
            return self._library([text])[0]
        if any(x in text for x in self.special):
            return self._library([text])[0]
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        own = {w: self.old[w] for w in new if w in self.old}
        new = [w for w in new if w not in own]
        own |= dict(zip(new, self._library([w.decode("latin-1") for w in new]), strict=True))
        if len(self.known) + len(own) > self.memory // 2:  # words that come again are taken over, the others go
            own |= {w: self.known[w] for w in set(words) if w in self.known}
            self.old, self.known = self.known, {}
        self.known.update(own)
        ids = b"".join(map(self.known.__getitem__, words))
        for w in own:
            if len(w) > 64:
                del self.known[w]
        return ids


_ENCODERS: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One a worker process, so that its memory serves all the tasks that run there."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each piece: the key, then PIECE; ids only if asked for."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        return out.astype({"doc_id": "Int64"}) if whole else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(definition.value)
        for batch in batches:
            rows, size = [], 0
            for k, t in zip(batch.doc_id, batch.text, strict=True):
                ids = (encoder.encode(t) if isinstance(t, str) else b"") + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    rows.append((k, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
                size += len(ids)
                if size > 4_000_000:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    kind = docs.select(F.col(key)).schema[0].dataType
    whole = isinstance(kind, T.IntegralType)
    return docs.select(F.col(key).cast("long" if whole else kind).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {'long' if whole else kind.simpleString()}, {PIECE}")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given (decreasing) order."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group_size: int = 8192, seed: int = 7) -> DataFrame:
    """pieces with sequence_id and offset. The pieces must not change between reads (checkpointed or a table)."""
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows.length.to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns="_group")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The packed pieces of docs; `with_ids`: with a column `ids`, little-endian unsigned 32-bit values, which takes no part in packing and is joined to it."""
    made = cut(docs, path, capacity, text=text, key=key, with_ids=with_ids)
    if not with_ids:
        return pack(checkpointed(made.drop("ids")), capacity)
    made = checkpointed(made.withColumn("piece", F.monotonically_increasing_id()))
    return pack(made.drop("ids"), capacity).join(made.select("piece", "ids"), "piece").drop("piece")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
