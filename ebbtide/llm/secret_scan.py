r"""Secret scans by a trigram inverted index.

Each rule's pattern is turned into a Boolean query of trigrams that every match must hold (alternatives become OR, what
follows one another AND, what can't be listed no condition). The texts of an Arrow batch are one segment of the index, as
in sharded code search: postings of the rules' trigrams over lower-cased bytes, built, intersected and verified in the
task that reads the segment, so no text is shuffled. A rule without a mandatory trigram (hex runs) scans every text.

Rules `assign`, `access` and `hex` are the base; the others add spans. Spans count code points, end exclusive.

Edge cases: null text is empty and has no span; masked, it stays null. Repeated rows give repeated results, an empty table
none. Texts of any length are scanned whole. Spans that begin at one place go by rule, in the order of RULES. Other columns
are passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import table
from ebbtide.llm.text import fresh, pieces

BASE = ("assign", "access", "hex")
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    least: int = 0  # characters of the group that counts; shorter matches are dropped
    group: int = 0


# The base patterns, then the forms of well-known public credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 24),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", re.ASCII, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", re.ASCII, 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.ASCII),
)
# Masking takes a key whole: to its END line, or where that is missing to the end of the key's header and base64 lines.
_BREAK = r"(?:[ \t]*(?:\r?\n|\\n))+[ \t]*"
_BODY = rf"(?:\s*[A-Za-z0-9+/]{{40,}}={{0,2}}|{_BREAK}(?:Proc-Type|DEK-Info):[^\n]*|{_BREAK}[A-Za-z0-9+/]+={{0,2}}(?=[ \t]*(?:\r?\n|\\n|$)))*"
MASKED = tuple(r if r.kind != "pem" else Rule("pem", rf"{r.pattern}(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|{_BODY})", r.flags) for r in RULES)
ALL = None  # the query that every text answers


def _all_of(*queries):
    kept = [q for q in queries if q is not ALL]
    return ALL if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def _any_of(queries: list):
    return ALL if any(q is ALL for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _held(strings: set[bytes]):
    """The query of a text that holds one of the strings."""
    return _any_of([_all_of(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def trigram_query(pattern: str, flags: int = 0, most: int = 64):
    """None, a trigram, or ("and" | "or", queries): what a text must hold, lower-cased, if the pattern matches in it."""

    def listed(op, arg) -> set[bytes] | None:
        """All strings the node matches, if they are few."""
        if op is sre.LITERAL:
            return {chr(arg).lower().encode()}
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(c).lower().encode() for _, c in arg}
        if op is sre.SUBPATTERN:
            return chain(arg[-1])
        if op is sre.BRANCH:
            each = [chain(x) for x in arg[1]]
            return None if None in each else set().union(*each)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
            once = chain(arg[2])
            if once is not None:
                times = [reduce(lambda a, _: {x + y for x in a for y in once}, range(n), {b""}) for n in range(arg[0], int(arg[1]) + 1)]
                return set().union(*times)
        return None

    def chain(nodes) -> set[bytes] | None:
        whole = {b""}
        for op, arg in nodes:
            own = listed(op, arg)
            if own is None or len(whole) * len(own) > most:
                return None
            whole = {x + y for x in whole for y in own}
        return whole

    def query(nodes):
        found, whole = ALL, {b""}
        for op, arg in nodes:
            own = listed(op, arg)
            if own is not None and len(whole) * len(own) <= most:
                whole = {x + y for x in whole for y in own}
                continue
            found, whole = _all_of(found, _held(whole)), own if own is not None else {b""}
            if own is None and op is sre.SUBPATTERN:
                found = _all_of(found, query(arg[-1]))
            elif own is None and op is sre.BRANCH:
                found = _all_of(found, _any_of([query(x) for x in arg[1]]))
            elif own is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found = _all_of(found, query(arg[2]))
        return _all_of(found, _held(whole))

    return query(parser.parse(pattern, flags))


def _trigrams(query) -> set[bytes]:
    return set() if query is ALL else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        # where no trigram is mandatory the text is scanned, for runs that are long enough at once
        self.full = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}", r.flags) if q is ALL and r.least and r.pattern.endswith("]+") and r.pattern.startswith("[") else p for r, q, p in zip(rules, self.queries, self.patterns, strict=True)]
        self.vocabulary = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.vocabulary, 1):
            self.number[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        """Sorted text numbers of each trigram of the rules."""
        parts = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts).lower() + b"\n\n\n", np.uint8).astype(np.uint32)
        number = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        both = np.unique(number[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right"))
        cuts = np.searchsorted(both >> 32, np.arange(1, len(self.vocabulary) + 2))
        return {t: both[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF for i, t in enumerate(self.vocabulary)}

    def candidates(self, query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is ALL:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[query]
        parts = (self.candidates(q, postings, n) for q in query[1])
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for k, rule in enumerate(self.rules):
            pattern = self.full[k]
            for i in self.candidates(self.queries[k], postings, len(texts)).tolist():
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in found]


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def find(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct column (RESULT)."""

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        names = [r.kind for r in rules]
        for batch in batches:
            rows = []
            for piece in pieces(batch, 4_000_000):
                for spans in scanner.scan(piece):
                    base = [x for x in spans if names[x[1]] in BASE]
                    rows.append((*(sum(names[x[1]] == b for x in base) for b in BASE), hashlib.sha256(_joined(base, rules).encode()).hexdigest(), _joined(spans, rules)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.asNondeterministic()(text)


def mask(text: Column, rules: tuple[Rule, ...] = RULES, put: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced; null stays null."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for batch in batches:
            out = []
            for piece in pieces(batch, 4_000_000):
                for whole, spans in zip(piece, scanner.scan(piece), strict=True):
                    parts, done = [], 0
                    for a, _, b in spans:
                        if a >= done:
                            parts += [whole[done:a], put]
                        done = max(done, b)
                    out.append("".join([*parts, whole[done:]]))
            yield pd.Series(out, dtype=object).where(batch.notna().to_numpy(), None)

    return masked.asNondeterministic()(text)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a struct column `secrets` (or a longer name)."""
    return docs.withColumn(fresh(docs, "secrets"), find(F.col(text), rules))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: all documents, secrets masked; n_chars, where there is one, follows the text."""
    masked = docs.withColumn("text", mask(F.col("text"), MASKED))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


# Matches and the gaps between them give the offsets; both are whole texts' lists, so SQL needs no scan of positions.
_KIND = """
select doc_id, {order} as o, '{kind}' as kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, length(m[i]) as n, {size} as size
from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as g from d))"""
_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_HEAD = """^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?"""
ORACLE = "with d as (select doc_id, coalesce(text, '') as t from documents), found as (" + " union all ".join(
    _KIND.format(order=o, kind=kind, pattern=pattern, size=size)
    for o, (kind, pattern, size) in enumerate(
        (
            ("assign", _ASSIGN.replace("\\\\", "\\"), f"length(regexp_replace(m[i], '{_HEAD}', ''))".replace("\\\\", "\\")),
            ("access", "AKIA[A-Z0-9]+", "length(m[i])"),
            ("hex", "[0-9a-f]{24,}", "length(m[i])"),
            ("forge", "gh[pousr]_[A-Za-z0-9]+", "length(m[i])"),
            ("chat", "xox[abprs]-[A-Za-z0-9-]+", "length(m[i])"),
            ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "length(m[i])"),
        )
    )
) + """), kept as (select * from found where size >= case kind when 'assign' then 6 when 'access' then 20 when 'hex' then 24 when 'forge' then 40 when 'chat' then 20 else 0 end),
told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) filter (o < 3) as base, string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) as spans from kept group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (doc_id)"""
