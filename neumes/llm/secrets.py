"""Secret scanning over a trigram inverted index.

For each rule a Boolean query over trigrams is derived from the parse of its
regular expression: literal alternatives become OR over AND of their trigrams,
parts that follow each other are joined by AND, and everything else asks for
nothing. Every segment of documents (a batch) gets an inverted index of the
trigrams that some query names, made in one pass over its bytes; postings are
intersected and united as the query says, and the expression runs over the
candidates alone. A rule whose expression has no mandatory trigram runs over all
documents.

Texts and expressions are bytes in UTF-8. The index holds trigrams of bytes with A-Z
lower-cased, so that one serves rules of either case.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, limit_batches, utf8

ALL = ("all",)
#: More alternatives than this end a literal: the query stays small.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0  # matches with fewer characters in that part are dropped


#: The base rules of the contract, in their order. A run of hex digits
#: that is long enough is found as such: shorter runs hold no match.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further spans, beside the base ones.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def trigrams(text: bytes):
    parts = [text[i : i + 3] for i in range(len(text) - 2)]
    return ("and", tuple(dict.fromkeys(parts))) if parts else ALL


def both(*queries):
    kept = tuple(dict.fromkeys(q for q in queries if q != ALL))
    return ALL if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def either(*queries):
    if ALL in queries:
        return ALL
    asked = {q: frozenset(q[1]) if q[0] == "and" else frozenset([q]) for q in queries}
    # an alternative that asks for more than another adds nothing
    kept = tuple(q for q in asked if not any(asked[p] < asked[q] for p in asked))
    return kept[0] if len(kept) == 1 else ("or", kept)


def derived(pattern: str):
    """The query that every text with a match of the pattern satisfies."""
    parsed = re._parser.parse(pattern.encode())

    def strings(node) -> set[bytes] | None:
        """All strings of a node, lower-cased, if they are few."""
        kind, value = str(node[0]), node[1]
        if kind == "LITERAL":
            return {bytes([value]).lower()}
        if kind == "IN":
            if any(str(k) != "LITERAL" for k, _ in value):
                return None
            return {bytes([v]).lower() for _, v in value}
        if kind == "SUBPATTERN":
            return sequence(value[3])
        if kind == "BRANCH":
            found = [sequence(x) for x in value[1]]
            return None if None in found else set().union(*found)
        if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 3:
            one = sequence(value[2])
            if one is None:
                return None
            out, power = ({b""} if value[0] == 0 else set()), {b""}
            for n in range(1, value[1] + 1):
                power = {a + b for a in power for b in one}
                if len(power) > ALTERNATIVES:
                    return None
                out |= power if n >= value[0] else set()
            return out
        return {b""} if kind == "AT" else None

    def sequence(nodes) -> set[bytes] | None:
        out = {b""}
        for node in nodes:
            found = strings(node)
            if found is None or len(out) * len(found) > ALTERNATIVES:
                return None
            out = {a + b for a in out for b in found}
        return out

    def inside(node):
        """What a node asks for whose strings are many."""
        kind, value = str(node[0]), node[1]
        if kind == "SUBPATTERN":
            return walk(value[3])
        if kind == "BRANCH":
            return either(*(walk(x) for x in value[1]))
        if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            return walk(value[2])
        return ALL

    def walk(nodes):
        query, now = ALL, {b""}
        for node in nodes:
            found = strings(node)
            if found is not None and len(now) * len(found) <= ALTERNATIVES:
                now = {a + b for a in now for b in found}
                continue
            query = both(query, either(*map(trigrams, sorted(now))))
            now = {b""} if found is None else found
            if found is None:
                query = both(query, inside(node))
        return both(query, either(*map(trigrams, sorted(now))))

    return walk(parsed)


def named(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*(named(q) for q in query[1])) if query != ALL else set()


class Trigrams:
    """The trigrams that some query names, numbered from 1; 0 for all others."""

    def __init__(self, queries):
        self.number = {t: i for i, t in enumerate(sorted(set().union(*map(named, queries))), 1)}
        self.table = np.zeros(1 << 24, np.uint16 if len(self.number) > 255 else np.uint8)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i


class Segment:
    """An inverted index of some documents: the sorted places of those that hold each named trigram."""

    def __init__(self, texts: list[bytes], trigrams: Trigrams):
        self.size, self.number = len(texts), trigrams.number
        ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0, np.int64)
        at = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
        found = trigrams.table[at[:-2] << 16 | at[1:-1] << 8 | at[2:]] if len(at) > 2 else trigrams.table[:0]
        at = np.flatnonzero(found)
        place = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[place] if len(ends) else np.empty(0, bool)  # no trigram of two documents
        keys = np.unique(found[at[inside]].astype(np.int64) * max(1, self.size) + place[inside])
        number, place = np.divmod(keys, max(1, self.size))
        edges = np.searchsorted(number, np.arange(len(self.number) + 2))
        self.postings = [place[b:e] for b, e in zip(edges, edges[1:])]

    def posting(self, trigram: bytes) -> np.ndarray:
        return self.postings[self.number[trigram]]

    def candidates(self, query) -> np.ndarray:
        if isinstance(query, bytes):
            return self.posting(query)
        if query == ALL:
            return np.arange(self.size)
        out = self.candidates(query[1][0])
        for q in query[1][1:]:
            if query[0] == "and" and not len(out):
                break
            out = (np.intersect1d if query[0] == "and" else np.union1d)(out, self.candidates(q))
        return out


def findings(rules: tuple[Rule, ...]):
    plans = [(derived(r.pattern), re.compile(r.pattern.encode())) for r in rules]
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        trigrams = Trigrams([query for query, _ in plans])
        for batch in batches:
            texts = utf8(batch.column(1))
            segment = Segment(texts, trigrams)
            out: list[list] = [[] for _ in texts]
            for place, (rule, (query, pattern)) in enumerate(zip(rules, plans)):
                for i in segment.candidates(query).tolist():
                    for m in pattern.finditer(texts[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[i].append((m.start(), place, m.end()))
            for i, found in enumerate(out):
                if not found:
                    continue
                text = texts[i]
                if text.isascii():
                    point = None
                else:  # code points that begin before each byte
                    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
                    point = np.concatenate([[0], np.cumsum(begins)])
                out[i] = [
                    {"kind": rules[place].kind, "start": int(s if point is None else point[s]), "end": int(e if point is None else point[e]), "value": text[s:e].decode()}
                    for s, place, e in sorted(found)
                ]
            yield pa.record_batch({"doc_id": batch.column(0), "findings": pa.array(out, kinds)})

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per document: doc_id, findings (kind, start, end, value) by start, then in the order of the rules.

    Matches are leftmost and non-overlapping within a rule; starts and ends count
    code points, end exclusive. Expressions are matched in bytes: classes and case
    folding know ASCII only. Null counts as empty, and such documents have no findings. Repeated rows are each scanned. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    limit_batches(docs.sparkSession)
    schema = "doc_id long, findings array<struct<kind:string,start:long,end:long,value:string>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(bounded(findings(rules), size=4 << 20), schema)


def span_text(found) -> "F.Column":
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
