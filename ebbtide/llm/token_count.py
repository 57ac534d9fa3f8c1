"""Token counts by a compiled finite-state tokenizer, for byte-level BPE with the usual contraction/letter/number split.

Two transducers. The splitter: a table from code point to one of 11 classes (asked of the tokenizer's own splitter, so its
Unicode version counts) and a deterministic machine of 12 states over those classes, whose transitions emit word starts at
this or the previous character. Texts of a batch form one stream with an end class between texts, cut into chunks of CHUNK
characters; all chunks advance in step from every entry state, which gives a state map for each; a parallel prefix scan
composes the maps; a second pass emits from the entry states now known.

The merges (`Merges`): a deterministic machine over bytes whose transitions emit the change of the token count. Its states
are compiled when first met, as far as memory allows. It starts anew at each word, so a word's map is the same from every
entry state, a text's count is the sum over its words, and the counts of words met before are looked up.

Edge cases: null text counts as empty: 0 bytes, 0 tokens. Added special tokens inside a text count one each, as the
library does by default. Repeated rows give repeated results, an empty table none. A text or word of any length is counted
whole. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import table
from ebbtide.llm.text import fresh, pieces

CHUNK = 256
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, STMD, R, V, L, E, END = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
LETTERS = (LETTER, STMD, R, V, L, E)
HERE, BEFORE = 1, 2  # a token starts at this character, at the one before
OPENS = {**dict.fromkeys(LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, OTHER: IN_OTHER, QUOTE: QUOTED, END: START}


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and what is emitted."""
    begin = (OPENS[kind], HERE)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return START, 0
        after, emitted = _step(IN_LETTERS, kind)
        return after, emitted | BEFORE
    if state == QUOTED:
        return {STMD: (START, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0), OTHER: (IN_OTHER, 0), QUOTE: (IN_OTHER, 0)}.get(kind, begin)
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if kind in (SPACE, WHITE):
            return (RUN_SPACE if kind == SPACE else RUN_WHITE), 0
        if kind == END:  # white space at the end stays whole
            return begin
        split = BEFORE if state in (RUN_SPACE, RUN_WHITE) else 0
        if state in (ONE_SPACE, RUN_SPACE):  # a blank joins the token after it
            return (IN_OTHER if kind == QUOTE else OPENS[kind]), split
        return begin[0], begin[1] | split
    goes_on = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHER: (OTHER, QUOTE)}.get(state, ())
    return (state, 0) if kind in goes_on else begin


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions at index state * 16 + class."""
    after, emitted = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for state in range(12):
        for kind in range(12):
            after[state * 16 + kind], emitted[state * 16 + kind] = _step(state, kind)
    return after, emitted


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (a row for each chunk), in a logarithmic number of rounds."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        d *= 2
    return maps


def token_starts(kinds: np.ndarray, tables: tuple[np.ndarray, np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """Whether a token starts, for each character of a stream of classes."""
    after, emitted = tables
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], rows, axis=1)
    for kind in grid:
        maps = after[(maps << 4) | kind]
    scanned = compose(np.ascontiguousarray(maps.T))
    state = np.zeros(rows, np.uint8)
    state[1:] = scanned[:-1, START]
    out = np.empty_like(grid)
    for k, kind in enumerate(grid):
        at = (state << 4) | kind
        out[k] = emitted[at]
        state = after[at]
    out = out.T.reshape(-1)[:n]
    starts = (out & HERE) > 0
    starts[:-1] |= (out[1:] & BEFORE) > 0
    return starts


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies show printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merges as a transducer: state and byte give the next state and the change of the token count.

    The tokens of a prefix are those of a shorter prefix and one more token, and there is one such pair whose border no
    merge crosses. A state therefore holds, for each place where a token that goes on could have begun, the trie node since
    then, the last token before it, and its token count less that of the whole prefix.
    """

    def __init__(self, merges: list, size: int = 400_000):
        byte_of = _byte_of()
        raw = lambda shown: bytes(byte_of[c] for c in shown)
        self.names = [bytes([b]) for b in range(256)]
        number = {n: i for i, n in enumerate(self.names)}
        self.pair: dict[tuple[int, int], int] = {}  # of two tokens: what they merge into; tokens are numbered as they are made
        self.halves: list[tuple[int, int] | None] = [None] * 256
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges):
            both = number[raw(a)], number[raw(b)]
            name = raw(a) + raw(b)
            if name in number:
                raise ValueError("two merges make the same token")
            self.pair[both] = number[name] = len(self.names)
            self.names.append(name)
            self.halves.append(both)
        if max(map(len, self.names)) > 255:
            raise ValueError("a token of more than 255 bytes")
        self.after: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token, self.inner = [-1], [False]
        whole = [True] * 256
        for t, halves in enumerate(self.halves):
            if halves:  # whether its own bytes give the token
                whole.append(whole[halves[0]] and whole[halves[1]] and self._apart(*halves, made=t))
            if whole[t]:
                self._add(t)
        self.size = size
        self.border: dict[int, bool] = {}
        self._clear()

    def _add(self, t: int) -> None:
        at = 0
        for b in self.names[t]:
            if (at << 8 | b) not in self.after:
                self.after[at << 8 | b] = len(self.token)
                self.inner[at] = True
                self.token.append(-1)
                self.inner.append(False)
            at = self.after[at << 8 | b]
        self.token[at] = t

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The pieces that are outermost on a side of the token while it is made, each with the token whose making ends it."""
        out, end = [], len(self.names)
        while True:
            out.append((t, end))
            if self.halves[t] is None:
                return out
            t, end = self.halves[t][side], t

    def _apart(self, a: int, b: int, made: int = -1) -> bool:
        """Whether no merge (but `made`) crosses the border of the bytes of a and b. A merge takes place if it comes before both pieces' own next ones; of equal merges the left goes first."""
        for x, x_end in self._edge(a, 1):
            for y, y_end in self._edge(b, 0):
                m = self.pair.get((x, y), -1)
                if m >= 0 and m != made and m < x_end and m <= y_end:
                    return False
        return True

    def _clear(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, int] = {}  # state * 256 + byte -> next state * 512 + change + 256
        self.border.clear()
        self._number((256,))  # the trie's root, no token before it, as many tokens as there are

    def _number(self, state: tuple[int, ...]) -> int:
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
        return self.known[state]

    def _compile(self, state: int, byte: int) -> int:
        """Add the move; a place is packed as (node * 2**20 + last token + 1) * 512 + difference + 256."""
        there = self.states[state]
        if len(self.moves) >= self.size:  # forget what was compiled
            self._clear()
            state = self._number(there)
        going, found = [], None
        for place in there:
            last, node, more = (place >> 9 & 0xFFFFF) - 1, place >> 29, (place & 511) - 256
            node = self.after.get(node << 8 | byte, -1)
            if node < 0:
                continue
            t = self.token[node]
            if t >= 0:
                key = last << 20 | t
                fits = last < 0 or self.border.get(key)
                if fits is None:
                    fits = self.border[key] = self._apart(last, t)
                if fits:
                    found = t, more + 1
            if self.inner[node]:
                going.append((node << 20 | last + 1, more))
        t, change = found
        state_after = self._number((*((head << 9) + more - change + 256 for head, more in going), t + 1 << 9 | 256))
        move = self.moves[state << 8 | byte] = state_after << 9 | change + 256
        return move

    def count(self, word: bytes) -> int:
        state = total = 0
        for byte in word:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move >> 9
            total += (move & 511) - 256
        return total


class Compiled:
    """A tokenizer, compiled; one for each worker process. The library's splitter is asked for classes of characters, for no count."""

    def __init__(self, definition: str, lexicon_size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        told = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.merges = Merges(told["model"]["merges"])
        self.kinds = np.full(0x110000, 255, np.uint8)
        self._classify(np.arange(0x3000))
        self.tables = compiled()
        self.lexicon: dict[str, int] = {}
        self.lexicon_size = lexicon_size

    def _classify(self, points: np.ndarray) -> None:
        """Ask the splitter which run each code point joins; done when a code point first appears."""
        chars = [chr(c) for c in points]
        kinds = np.full(len(chars), WHITE, np.uint8)
        for lead, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            starts = {at[0] for _, at in self.library.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{c}\n\n" for c in chars))}
            kinds[[i for i in range(len(chars)) if 4 * i + 1 not in starts]] = kind
        self.kinds[points] = kinds
        for c, kind in ((" ", SPACE), ("'", QUOTE), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.kinds[ord(c)] = kind

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner = list(texts), np.arange(len(texts))
        extra = np.zeros(len(texts), np.int64)
        if any(s in t for s in self.special for t in texts):
            parts, owners = [], []
            for i, t in enumerate(texts):
                split = [t]
                for s in self.special:
                    split = [x for y in split for x in y.split(s)]
                extra[i] = len(split) - 1
                parts += split
                owners += [i] * len(split)
            owner = np.array(owners)
        stream = "\n".join(parts) + "\n"
        codes = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[codes]
        if (kinds == 255).any():
            self._classify(np.unique(codes[kinds == 255]))
            kinds = self.kinds[codes]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
        kinds[ends] = END
        starts = np.flatnonzero(token_starts(kinds, self.tables))
        words = [stream[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(stream)], strict=True)]
        emitted = np.fromiter(map(self.lexicon.get, words, repeat(-1)), np.int64, len(words))
        closing = kinds[starts] == END
        emitted[closing] = 0
        new = np.flatnonzero(emitted < 0)
        if len(new):
            counts = {w: self.merges.count(w.encode()) for w in dict.fromkeys(words[i] for i in new.tolist())}
            emitted[new] = [counts[words[i]] for i in new.tolist()]
            if len(self.lexicon) + len(counts) > self.lexicon_size:
                self.lexicon.clear()
            self.lexicon.update((w, n) for w, n in counts.items() if len(w) <= 64)
        per_part = np.bincount(np.searchsorted(ends, starts), emitted, len(parts)).astype(np.int64)
        return np.bincount(owner, per_part, len(texts)).astype(np.int64) + extra


_MACHINES: dict[int, Compiled] = {}


def _machine(definition: str) -> Compiled:
    """One a worker process, so that its lexicon serves all the tasks that run there."""
    key = zlib.crc32(definition.encode())
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Compiled(definition)
    return _MACHINES[key]


def n_tokens(text: Column, definition) -> Column:
    """Tokens of a text column; `definition` is a broadcast tokenizer file."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _machine(definition.value)
        for batch in batches:
            counts = [machine.count(piece) for piece in pieces(batch, 1_000_000)]
            yield pd.Series(np.concatenate(counts) if counts else np.zeros(0, np.int64))

    return counted.asNondeterministic()(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with a struct column `tokens` (or a longer name): n_bytes, n_tokens, over_limit."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    name = fresh(docs, "tokens")
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn(name, n_tokens(F.col(text), definition))
    return counted.withColumn(name, F.struct(F.octet_length(whole).cast("long").alias("n_bytes"), F.col(name).alias("n_tokens"), (F.col(name) > limit).alias("over_limit")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "tokens.*")
