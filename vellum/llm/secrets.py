"""Secret scanning over a trigram inverted index.

Every rule is a regular expression.  Its syntax tree yields a Boolean query
over the trigrams that any match must contain: literals that follow one another
join to strings, small classes and branches multiply them out, and whatever is
optional or open ends a string.  A segment of text of about half a megabyte is
indexed by the trigrams that some rule asks for (bytes, ASCII letters folded),
postings are intersected and united as the query says, and the expression runs
on the remaining documents alone.  Rules without mandatory trigrams scan every
document.  Index segments live only as long as their slice, so there is no
shuffle and nothing to keep in step with the documents.

Expressions use ASCII classes.  Secrets are reported by place, length and MD5,
never in clear.

Defined results: null and empty texts hold nothing; repeated rows are each
reported; very long texts are a segment of their own and scanned whole; ids keep
their type and may be null; an empty table holds nothing; only id and text are
read, whatever other columns are called.  Ties: of matches of one rule that
overlap the first one is reported, those of several rules may overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.shared import col, id_type
from vellum.llm.textkit import slices, text_buffers

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |)PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{24,}",
    "assigned_secret": r"(?i)\b(?:token|secret|passwd|password|api_?key)\s{0,3}[:=]\s{0,3}['\"][^\s'\"]{8,}['\"]",
    "url_credentials": r"[a-z]{3,10}://[^\s:/@]+:[^\s:/@]+@",
    "payment_card": r"\b(?:4[0-9]{15}|5[1-5][0-9]{14})\b",
    "hex_key": r"\b[0-9a-f]{40}\b",
}

#: Strings that one stretch of an expression may stand for before it is cut.
_MOST = 32

# A query is a trigram, ("and", ...), ("or", ...) or None, which holds always.
Query = int | tuple | None


def _fold(text: str) -> bytes:
    return text.encode().lower()


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _strings(words: set[bytes]) -> Query:
    return _any_of([_all_of([w[i] << 16 | w[i + 1] << 8 | w[i + 2] for i in range(len(w) - 2)]) for w in sorted(words)])


class _Stretch:
    """Strings that the expression may have just matched, and what holds so far."""

    def __init__(self) -> None:
        self.words: set[bytes] = {b""}
        self.holds: list[Query] = []

    def cut(self) -> None:
        self.holds.append(_strings(self.words))
        self.words = {b""}

    def put(self, choices: set[bytes]) -> None:
        if len(self.words) * len(choices) > _MOST:
            self.cut()
        if len(choices) > _MOST:
            return
        self.words = {a + b for a in self.words for b in choices}

    def query(self) -> Query:
        return _all_of([*self.holds, _strings(self.words)])


def _class_of(items: list) -> set[bytes] | None:
    """The characters of a class, if they are few."""
    out: set[bytes] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(_fold(chr(value)))
        elif kind is sre.RANGE and value[1] - value[0] < _MOST:
            out |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= _MOST else None


def _walk(items, at: _Stretch) -> None:
    for kind, value in items:
        if kind is sre.LITERAL:
            at.put({_fold(chr(value))})
        elif kind is sre.IN:
            few = _class_of(value)
            at.put(few) if few else at.cut()
        elif kind is sre.SUBPATTERN:
            _walk(value[3], at)
        elif kind is sre.AT:
            continue
        elif kind is sre.BRANCH:
            branches = []
            for branch in value[1]:
                inner = _Stretch()
                _walk(branch, inner)
                branches.append(inner)
            if all(not b.holds for b in branches):
                at.put({w for b in branches for w in b.words})
            else:
                at.cut()
                at.holds.append(_any_of([b.query() for b in branches]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, body = value
            inner = _Stretch()
            _walk(body, inner)
            if not inner.holds and low == high and low <= 8:
                for _ in range(low):
                    at.put(inner.words)
            elif not inner.holds and (low, high) == (0, 1):
                at.put(inner.words | {b""})
            else:
                at.cut()
                if low:
                    at.holds.append(inner.query())
        else:
            at.cut()


def trigram_query(pattern: str) -> Query:
    """What any text that matches must contain; None where nothing is certain."""
    at = _Stretch()
    _walk(sre_parser.parse(pattern, re.ASCII), at)
    return at.query()


def trigrams_of(query: Query) -> set[int]:
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*(trigrams_of(q) for q in query[1:]))


def candidates(query: Query, postings: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """Rows whose trigrams satisfy a query, ascending."""
    if query is None:
        return np.arange(rows)
    if isinstance(query, int):
        return postings.get(query, np.zeros(0, np.int64))
    parts = [candidates(q, postings, rows) for q in query[1:]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def index_slice(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Rows of each wanted trigram; `wanted` is a table of 2**24 flags."""
    base = offsets[0]
    text, bounds = _FOLD[raw[base : offsets[-1]]].astype(np.uint32), offsets - base
    if len(text) < 3:
        return {}
    code = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
    at = np.flatnonzero(wanted[code])
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + 2 < bounds[row + 1]
    pair = np.unique((code[at[inside]].astype(np.int64) << 32) | row[inside])
    trigram = pair >> 32
    first = np.flatnonzero(np.concatenate([[True], trigram[1:] != trigram[:-1]])) if len(pair) else np.zeros(0, np.int64)
    return dict(zip(trigram[first].tolist(), np.split(pair & 0xFFFFFFFF, first[1:])))


def scanner(rules: dict[str, str]):
    """A mapInArrow function from (doc_id, text) to the secrets found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        queries = {name: trigram_query(p) for name, p in rules.items()}
        wanted = np.zeros(1 << 24, dtype=bool)
        wanted[sorted(set().union(*map(trigrams_of, queries.values())))] = True
        for batch in batches:
            ids, (raw, offsets) = batch.column(0), text_buffers(batch.column(1))
            for a, b in slices(offsets):
                postings = index_slice(raw, offsets[a : b + 1], wanted)
                texts: dict[int, str] = {}
                found: list[tuple] = []
                for name, query in queries.items():
                    for r in candidates(query, postings, b - a).tolist():
                        if r not in texts:
                            texts[r] = raw[offsets[a + r] : offsets[a + r + 1]].tobytes().decode()
                        for n, m in enumerate(compiled[name].finditer(texts[r]), 1):
                            found.append((a + r, name, n, m.start(), m.end() - m.start(), hashlib.md5(m.group().encode()).hexdigest()))
                if found:
                    row, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *map(pa.array, rest)], ["doc_id", "rule", "occurrence", "start", "length", "secret_md5"])

    return run


def secrets(docs: DataFrame, rules: dict[str, str] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, rule, occurrence, start, length, secret_md5) of every match."""
    source = docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text"))
    return source.mapInArrow(scanner(dict(rules)), f"doc_id {id_type(docs, id_column)}, rule string, occurrence bigint, start bigint, length bigint, secret_md5 string")


def _sql() -> str:
    quoted = {n: p.replace("'", "''") for n, p in RULES.items()}
    hits = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS rest FROM documents WHERE regexp_matches(text, '{p}')" for n, p in quoted.items())
    return f"""
WITH hit AS ({hits}), each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS occurrence FROM hit)
SELECT doc_id, rule, occurrence,
  (list_sum(list_transform(rest[1:occurrence], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:occurrence - 1], lambda x: length(x))), 0))::BIGINT AS start,
  length(hits[occurrence]) AS length, md5(hits[occurrence]) AS secret_md5
FROM each
"""


SECRET_SQL = _sql()
