"""Secret scans with a trigram inverted index.

From the parse of each rule's regex comes a Boolean query over the trigrams that any match must
hold, in lower case. Each block of texts gets an inverted index of the trigrams that occur in some
query; postings are intersected and united, and the regex runs only over the texts that remain.
Rules without a mandatory trigram run over every text.

A null or empty text has no spans. Offsets are code points, the end exclusive. Matches of one kind
don't overlap; those of different kinds may. Repeated rows are scanned each; a long text is scanned whole,
alone in its block; an empty table gives no row; other columns of the frame are not looked at
(``redact_documents`` keeps them). Signs that match beyond A-Z when case is ignored ask for no trigram.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import flat_utf8, id_and_text, slices, strings

#: The base kinds in their order: regex, the group that is measured, its least length.
BASE_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, after the published forms of these credentials.
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
)
#: Most strings that a stretch of a regex is spelled out to.
MOST_STRINGS = 64


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _spelled(found: set[str]) -> object:
    """The query for one of some strings; a string under three bytes asks for nothing."""
    alternatives = []
    for text in sorted(found):
        raw = text.encode()
        alternatives.append(_all([("tri", raw[i : i + 3]) for i in range(len(raw) - 2)]))
    return _any(alternatives)


def _sequence(nodes, fold: bool) -> tuple[set[str] | None, object]:
    """All strings that match, if they are few, else None; and the query that any match fulfils."""
    exact, parts, whole = {""}, [], True
    for op, value in nodes:
        found, query = _node(op, value, fold)
        if found is not None and len(exact) * len(found) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in found}
            continue
        parts.append(_spelled(exact))
        whole = False
        exact = found if found is not None else {""}
        parts.append(query)
    parts.append(_spelled(exact))
    return (exact if whole else None), _all(parts)


def _sign(code: int, fold: bool) -> str | None:
    """A literal as the index has it, A-Z in lower case; None if ignoring case lets it match signs beyond ASCII."""
    sign = chr(code)
    if fold and (code > 127 or sign in "iskISK"):
        return None
    return sign.lower() if code < 128 else sign


def _node(op, value, fold: bool) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        sign = _sign(value, fold)
        return (None if sign is None else {sign}), True
    if op is sre.IN:
        found = {_sign(v, fold) if k is sre.LITERAL else None for k, v in value}
        return (found, _spelled(found)) if None not in found and len(found) <= 6 else (None, True)
    if op is sre.SUBPATTERN:
        _, more, less, inner = value
        return _sequence(inner, bool((fold or more & re.IGNORECASE) and not less & re.IGNORECASE))
    if op is sre.BRANCH:
        each = [_sequence(x, fold) for x in value[1]]
        if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= MOST_STRINGS:
            found = set().union(*(e for e, _ in each))
            return found, _spelled(found)
        return None, _any([q for _, q in each])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        found, query = _sequence(inner, fold)
        if found is not None and least == 0 and most == 1:
            return {""} | found, True
        if found is not None and least == most == 1:
            return found, query
        return None, query if least else True
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """A Boolean query of trigrams in lower case that every match fulfils; True asks for nothing."""
    parsed = sre_parser.parse(pattern)
    return _sequence(parsed, bool(parsed.state.flags & re.IGNORECASE))[1]


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    kind, value = query
    return {value} if kind == "tri" else set().union(*map(trigrams, value))


class Scanner:
    def __init__(self, rules: tuple):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in rules]
        self.rank = {kind: i for i, (kind, *_) in enumerate(rules)}
        self.wanted = sorted(set().union(*(trigrams(r[4]) for r in self.rules)))
        self.number = np.zeros(1 << 24, dtype=np.uint8 if len(self.wanted) < 256 else np.uint16)
        for i, t in enumerate(self.wanted):
            self.number[int.from_bytes(t, "big")] = i + 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def index(self, flat: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """The texts that hold each wanted trigram."""
        low = self.lower[flat].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        number = self.number[code]
        at = np.flatnonzero(number)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(number[at[inside]].astype(np.int64) * len(offsets) + text[inside])
        which, text = pairs // len(offsets) - 1, pairs % len(offsets)
        cuts = np.searchsorted(which, np.arange(len(self.wanted) + 1))
        return {t: text[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.wanted)}

    def select(self, query: object, index: dict[bytes, np.ndarray], texts: int) -> np.ndarray:
        if query is True:
            return np.arange(texts)
        kind, value = query
        if kind == "tri":
            return index[value]
        found = [self.select(q, index, texts) for q in value]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out

    def scan(self, texts: list[str], flat: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
        index = self.index(flat, offsets)
        spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for kind, regex, group, least, query in self.rules:
            for i in self.select(query, index, len(texts)).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        spans[i].append((kind, m.start(), m.end()))
        for found in spans:
            found.sort(key=lambda s: (s[1], self.rank[s[0]]))
        return spans


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan_documents(df: DataFrame, rules: tuple = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``spans`` array of (kind, start, end) by start, then by the order of the rules."""

    def run(batches):
        tool = scanner(rules)
        for batch in batches:
            for part in slices(batch, "text"):
                found = tool.scan(strings(part, "text"), *flat_utf8(part, "text"))
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, type=kind)], names=["doc_id", "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact_documents(df: DataFrame, rules: tuple = BASE_RULES + MORE_RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with each secret replaced by its kind in brackets; overlapping spans become one."""
    columns = df.columns

    def run(batches):
        tool = scanner(rules)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = strings(part, text_col)
                out: list[str | None] = []
                for text, old, spans in zip(texts, part.column(text_col).to_pylist(), tool.scan(texts, *flat_utf8(part, text_col))):
                    pieces, at = [], 0
                    for kind, start, end in spans:
                        if start >= at:
                            pieces += [text[at:start], f"[{kind}]"]
                        at = max(at, end)
                    out.append("".join(pieces) + text[at:] if spans else old)
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()) if c == text_col else part.column(c) for c in columns], names=columns)

    done = df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, df.schema)
    if length_col and length_col in columns:
        done = done.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return done.select(*columns)
