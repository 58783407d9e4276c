"""Operator 3, secret scans through a trigram inverted index.

*Queries.* Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold
(letters folded to lower case): literals in a row give trigrams joined by AND, alternatives by OR. A rule without
mandatory trigrams has the query True and scans all texts.

*Index.* The index is split by documents, as distributed search engines do: every slice of a partition has its own
postings, trigram -> texts, so nothing is shuffled and a lost executor repeats only its partition. Postings are kept for
the trigrams that some query names. A rule's candidates are the intersections and unions of postings that its query
asks for.

*Verification.* Candidates are searched by the rule itself: leftmost matches that do not overlap, per kind; then matches
that are too short are dropped. Spans are in code points, the end exclusive.

Null and empty texts have no spans. Rows are searched one by one, also repeated ones; only ``doc_id`` and ``text`` are
read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.shared import read
from framelake.llm.text_blocks import LOWER, raw, slices

Query = bool | bytes | tuple
#: Exact strings kept while a query is derived; beyond it what is known so far becomes trigrams.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    least: int = 1  # characters of ``group``
    group: int = 0
    before: str = ""  # characters that may not stand in front: a run is tried once, at its start


#: The three base rules, then those that the method adds (fixed public token formats).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 24),
)
MORE = (
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", before="A-Za-z0-9_-"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@", before="a-z0-9+.-"),
)
RULES = BASE + MORE


def _strings(words: set[str]) -> Query:
    """What a text holding one of the words holds: OR over words of AND over their trigrams."""
    options: list[Query] = []
    for word in words:
        data = word.lower().encode()
        if len(data) < 3:
            return True
        options.append(_all([data[i:i + 3] for i in range(len(data) - 2)]))
    return _any(options)


def _all(parts: list[Query]) -> Query:
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else (p,))}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _exact(node: tuple) -> set[str] | None:
    """The strings that a node of the parsed pattern matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        return None
    if op is sre.SUBPATTERN:
        return _exact_row(arg[3])
    if op is sre.BRANCH:
        rows = [_exact_row(row) for row in arg[1]]
        return None if any(r is None for r in rows) else set().union(*rows)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
        one = _exact_row(arg[2])
        return None if one is None else one | {""}
    return {""} if op is sre.AT else None


def _exact_row(row) -> set[str] | None:
    out = {""}
    for node in row:
        more = _exact(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _row_query(row) -> Query:
    parts: list[Query] = []
    known = {""}
    for node in row:
        more = _exact(node)
        if more is not None and len(known) * len(more) <= MOST_STRINGS:
            known = {a + b for a in known for b in more}
            continue
        parts.append(_strings(known))
        known = {""}
        op, arg = node
        if more is not None:
            known = more
        elif op is sre.SUBPATTERN:
            parts.append(_row_query(arg[3]))
        elif op is sre.BRANCH:
            parts.append(_any([_row_query(r) for r in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            parts.append(_row_query(arg[2]))
    return _all([*parts, _strings(known)])


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """True, a trigram, or ("and" | "or", queries): what every text with a match holds."""
    return _row_query(_parser.parse(pattern, flags))


def _named(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*(_named(q) for q in query[1]))
    return set() if query is True else {query}


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class TrigramIndex:
    """Postings of a slice of texts for the trigrams that are asked for."""

    def __init__(self, texts: pa.Array, wanted: np.ndarray):
        data, at = raw(texts)
        data = LOWER[data].astype(np.uint32)
        self.texts = len(texts)
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        place = np.flatnonzero(wanted[code])
        owner = np.searchsorted(at, place, "right") - 1
        inside = place + 3 <= at[owner + 1]
        pair = np.unique(code[place[inside]].astype(np.int64) * self.texts + owner[inside])
        code, owner = pair // self.texts, pair % self.texts
        if not len(code):
            return
        names, first = np.unique(code, return_index=True)
        self.postings = dict(zip(names.tolist(), np.split(owner, first[1:]), strict=True))

    def texts_of(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.texts)
        if isinstance(query, bytes):
            return self.postings.get(_code(query), np.zeros(0, np.int64))
        lists = sorted((self.texts_of(q) for q in query[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            if query[0] == "and" and not len(out):
                break
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


def _matches(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _compiled(rule: Rule) -> re.Pattern:
    # runs below the least length never count: the engine may skip them at once
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    return re.compile(f"(?<![{rule.before}]){pattern}" if rule.before else pattern, rule.flags)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; by start, then in the order of the rules) of every row of ``docs``."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        wanted[[_code(t) for q in queries for t in _named(q)]] = True
        compiled = [_compiled(r) for r in rules]
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part, texts in slices(batch, "text"):
                index = TrigramIndex(texts, wanted)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
                whole = texts.to_pylist()
                for k, rule in enumerate(rules):
                    for i in index.texts_of(queries[k]).tolist():
                        found[i] += [(a, k, b) for a, b in _matches(rule, compiled[k], whole[i])]
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(rows, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = find_secrets(read(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def _sql_pattern(rule: Rule) -> str:
    """The rule for an engine whose case folding knows more than ASCII: letters in either case are spelled out."""
    pattern = rule.pattern
    if rule.flags & re.IGNORECASE:
        word = re.compile(r"[a-z]{3,}")
        pattern = word.sub(lambda m: "".join(f"[{c}{c.upper()}]" for c in m[0]), pattern)
    if _leads(rule):
        pattern = f"(?:^|[^{rule.before}]){pattern}"
    return pattern.replace("'", "''")


def _leads(rule: Rule) -> bool:
    """Whether a match has to take the character in front with it: there is no looking back here. The leftmost match of a
    pattern that begins with its own class begins at the start of the run anyway."""
    return bool(rule.before) and not rule.pattern.startswith(f"[{rule.before}]+")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """Spans from the matches in order: each is the first occurrence of its text behind the one before."""
    finds = " UNION ALL ".join(f"""SELECT doc_id, k, kind, f,
      length({f"regexp_extract(f.m, '{_sql_pattern(r)}', {r.group})" if r.group else 'f.m'}) >= {r.least} AS long
      FROM (SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_reduce(regexp_extract_all(t, '{_sql_pattern(r)}'),
      lambda a, m: {{'pos': a.pos + strpos(substr(t, a.pos + 1), m) - 1 + length(m), 'spans': list_append(a.spans,
        {{'s': a.pos + strpos(substr(t, a.pos + 1), m) - 1, 'm': m}})}},
      {{'pos': 0::BIGINT, 'spans': []::STRUCT(s BIGINT, m VARCHAR)[]}}).spans) AS f FROM d)"""
                               for k, r in enumerate(rules))
    leads = " ".join(f"WHEN k = {k} AND regexp_matches(f.m, '^[^{r.before}]') THEN 1" for k, r in enumerate(rules) if _leads(r))
    leads = leads or "WHEN false THEN 0"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({finds}),
placed AS (SELECT doc_id, k, kind, f.s + CASE {leads} ELSE 0 END AS s, f.s + length(f.m) AS e FROM found WHERE long),
spans AS (SELECT doc_id, k, s, kind || ':' || s || ':' || e AS shown FROM placed)
SELECT d.doc_id, """ + ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE)) + f""",
  sha256(coalesce(string_agg(shown, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(shown, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id"""


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES = {"op3_secret_scan": oracle()}
