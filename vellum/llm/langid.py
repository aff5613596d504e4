"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from labelled text.  A document
is cut greedily into phrases, each the longest that occurs in that text; the
fewer phrases it takes, the nearer the document is to the language.  A phrase
is a reference into the text, so phrases are weighted with the logarithm of its
length and divided by the length of the document: bits per character.  The
language with the fewest wins.

Matching goes through one table of all automata in which a failed step already
holds the state after the new phrase's first character, so every character is
one table look-up, made for a thousand documents and all languages at once.  A
long text is parsed in pieces at once: each piece begins as if a phrase did, and
goes on into the next one until both are in the same state, from where on they
are the same parse; what a piece did before that is not counted.  Should two
pieces not meet, the text is parsed in one go, so the phrases are always those
of the whole text.

Training text is a bounded sample of whole texts: of each language `TRAIN_DOCS`
documents by hash, and of these, shortest first, as many as fit into `TRAIN_CHARS`
bytes, at least one.  Whole texts of all documents are classified.

Defined results: text without letters has a null language; null labels train
nothing; without any labelled text every language is null; repeated rows are each
classified; ids keep their type and may be null; an empty table gives no rows;
only id, text and, for training, lang are read, whatever other columns are called.
Ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import col, content_key, id_type
from vellum.llm.textkit import release_memory, slices, text_buffers, tidy

TRAIN_DOCS, TRAIN_CHARS = 120, 48_000
SEED = 11
LANES = 2048
#: Bytes of a piece of a long text, and how far it goes on into the next one.
PIECE, OVERLAP = 2048, 128
#: Bytes of text worked on at once.
SLICE = 4 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def normal(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with all but letters made spaces."""
    return np.where(_LETTER[raw], raw, np.uint8(32))


class Parser:
    """All languages' automata in one table.

    Entry (state, symbol) is the next state, plus 2**28 for each phrase that
    the step ends.
    """

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.languages = sorted(texts)
        texts = {k: normal(np.frombuffer(texts[k], dtype=np.uint8)).tobytes() for k in self.languages}
        known = sorted(set(b"".join(texts.values())))
        self.width = len(known) + 1
        self.symbol = np.zeros(256, dtype=np.uint8)
        self.symbol[known] = np.arange(1, len(known) + 1)
        tables, self.roots, base = [], [], 0
        for name in self.languages:
            steps = suffix_automaton(texts[name])
            table = np.full((len(steps), self.width), -1, dtype=np.int32)
            for s, d in enumerate(steps):
                if d:
                    table[s, self.symbol[list(d)]] = list(d.values())
            # A step that fails ends a phrase and begins the next one at the root;
            # a symbol that the text doesn't have is a phrase of its own.
            begin = np.where(table[0] < 0, 1 << 28, table[0] + base)
            begin[table[0] < 0] += base
            ends = (np.arange(len(steps)) > 0).astype(np.int32) << 28
            tables.append(np.where(table < 0, begin.astype(np.int32) + ends[:, None], table + np.int32(base)))
            self.roots.append(base)
            base += len(steps)
            del steps
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.cost = np.log2([max(len(texts[k]), 2) for k in self.languages])

    def _walk(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, overlap: int = 0) -> tuple[np.ndarray, ...]:
        """States and phrase ends after each stretch of symbols, longest stretch first.

        With `overlap`, also those after each of the first steps and of the steps
        from PIECE on, as [step, stretch, language].
        """
        roots = np.array(self.roots, dtype=np.int32)
        state = np.tile(roots, (len(begin), 1))
        count = np.zeros(state.shape, dtype=np.int32)
        seen = [np.zeros((overlap, *state.shape), dtype=np.int32) for _ in range(4)] if overlap else []
        # Stretches are in order of length, so those still active are the first ones.
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(begin) else []
        for t, m in enumerate(active):
            step = self.table[state[:m] * self.width + symbols[begin[:m] + t][:, None]]
            count[:m] += step >> 28
            state[:m] = step & 0xFFFFFFF
            if t < overlap:
                seen[0][t], seen[1][t] = state, count
            elif PIECE <= t < PIECE + overlap:
                seen[2][t - PIECE], seen[3][t - PIECE] = state, count
        return (state, count, *seen)

    def _slowly(self, symbols: np.ndarray, state: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """What `_walk` gives for one stretch and language, character by character; last steps' too."""
        table, width, count = memoryview(self.table), self.width, 0
        states, counts = [], []
        for symbol in symbols.tolist():
            step = table[state * width + symbol]
            state = step & 0xFFFFFFF
            count += step >> 28
            states.append(state)
            counts.append(count)
        return state, count, np.array(states[-OVERLAP:]), np.array(counts[-OVERLAP:])

    def _long(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases of some long texts, whose pieces are all parsed at once."""
        pieces, some = (end - begin) // PIECE, LANES // 4
        row = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, last = begin[row] + nth * PIECE, nth == pieces[row] - 1
        stop = np.where(last, end[row], start + PIECE + OVERLAP)
        total = np.zeros((len(begin), len(self.roots)), dtype=np.int64)
        # Phrase ends that a piece counted before it was in step, or the state in
        # which the piece before it ended without getting in step.
        skip, apart = [0] * len(self.roots), [-1] * len(self.roots)
        for g in range(0, len(row), some):
            # The last piece may be there only for its beginning.
            mine = np.arange(g, min(g + some + 1, len(row)))
            order = np.argsort(start[mine] - stop[mine], kind="stable")
            state, count, heads, head_counts, tails, tail_counts = self._walk(symbols, start[mine][order], (stop - start)[mine][order], OVERLAP)
            at = np.argsort(order)
            for i, p in enumerate(mine[:some].tolist()):
                for k, root in enumerate(self.roots):
                    if apart[k] < 0:
                        ended, ends, states, counts = state[at[i], k], count[at[i], k] - skip[k], tails[:, at[i], k], tail_counts[:, at[i], k] - skip[k]
                    else:
                        ended, ends, states, counts = self._slowly(symbols[start[p] + OVERLAP : stop[p]], apart[k])
                    if last[p]:
                        total[row[p], k] += ends + (ended != root)
                        skip[k], apart[k] = 0, -1
                        continue
                    same = np.flatnonzero(states == heads[:, at[i + 1], k])
                    if len(same):
                        total[row[p], k] += counts[same[0]]
                        skip[k], apart[k] = int(head_counts[same[0], at[i + 1], k]), -1
                    else:
                        total[row[p], k] += ends
                        apart[k] = int(ended)
        return total

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages) phrases that each row's bytes take."""
        n, roots = len(offsets) - 1, np.array(self.roots, dtype=np.int32)
        symbols = self.symbol[normal(raw)]
        size = np.diff(offsets)
        out = np.zeros((n, len(roots)), dtype=np.int64)
        long = np.flatnonzero(size >= 2 * PIECE)
        if len(long):
            out[long] = self._long(symbols, offsets[long], offsets[long + 1])
        short = np.flatnonzero(size < 2 * PIECE)
        longest = short[np.argsort(-size[short], kind="stable")]
        for g in range(0, len(longest), LANES):
            rows = longest[g : g + LANES]
            state, count = self._walk(symbols, offsets[rows], size[rows])
            out[rows] = count + (state != roots)
        return out


_PARSERS: dict[int, Parser] = {}


def _parser(texts: dict[str, bytes]) -> Parser:
    """One parser for each training text and worker process."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
        release_memory()
    return _PARSERS[key]


def whole_texts(texts: list[bytes], most: int) -> bytes:
    """Texts, shortest first, that fit into `most` bytes, with a space before each; at least one."""
    out, used = [], 0
    for text in sorted(texts, key=lambda t: (len(t), t)):
        used += len(text) + 1
        if out and used > most:
            break
        out.append(b" " + text)
    return b"".join(out)


def training_text(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> dict[str, bytes]:
    """A bounded sample of labelled text for each language."""
    key = content_key(docs)
    order = F.xxhash64("key", F.lit(SEED))
    lettered = F.lower(col("text").cast("string")).rlike("[a-z]|[^\\x00-\\x7f]")
    labelled = docs.where("lang is not null").where(lettered).select(col("lang").cast("string").alias("lang"), key.alias("key"), F.octet_length(col("text").cast("string")).alias("size")).distinct()
    # The limit for each language is applied before the shuffle, too.
    sample = labelled.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(order, "key"))).where(F.col("n") <= docs_per_language)
    # What doesn't fit is left out here already, so that no text of any length
    # beyond the budget comes to the driver, but for a language's only one.
    fits = Window.partitionBy("lang").orderBy("size", "key")
    chosen = sample.withColumn("before", F.sum("size").over(fits) - F.col("size")).where(F.col("before") <= chars).select("lang", "key")
    # A bounded number of keys for each language, so broadcasting is safe.
    rows = docs.select(col("text").cast("string").alias("text"), key.alias("key")).join(F.broadcast(chosen), "key").select("lang", F.lower("text").alias("text"), "key").distinct().toArrow().to_pylist()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return {k: whole_texts(v, chars) for k, v in texts.items()}


def identify(docs: DataFrame, texts: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, language, bits) of every row; bits per byte of the winner."""
    held = docs.sparkSession.sparkContext.broadcast(texts)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(held.value)
        names = pa.array(parser.languages, pa.string())
        for batch in batches:
            all_bytes, all_offsets = text_buffers(pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")))
            for a, b in slices(all_offsets, SLICE):
                ids, n = batch.column(0).slice(a, b - a), b - a
                if not parser.languages:
                    yield pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], ["doc_id", "language", "bits"])
                    continue
                raw, offsets = all_bytes[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a]
                letters = np.flatnonzero(_LETTER[raw])
                void = np.searchsorted(letters, offsets[1:]) == np.searchsorted(letters, offsets[:-1])
                bits = parser.phrases(raw, offsets) * parser.cost / np.maximum(np.diff(offsets), 1)[:, None]
                best = bits.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(best, mask=void)), pa.array(bits[np.arange(n), best], mask=void)], ["doc_id", "language", "bits"])

    return docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type(docs, id_column)}, language string, bits double")
