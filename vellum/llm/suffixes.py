"""Repeated passages by suffix arrays built in two stages.

A passage of `MIN_WORDS` words or more that occurs twice, in different documents
or in one, is found wherever it lies.

Copies first.  Rows of the same text are one text with several owners; such a text
is a passage as a whole, and only one of its rows is looked at further.

Finding where to look.  Of every 31 consecutive 20-word hashes the smallest is
an *anchor*, so two copies of 50 words share at least one anchor.  Anchors that
occur once are dropped.  Around each other anchor 30 words on either side are
cut out; whatever repeats at an anchor shows at least 50 words of itself there,
and the pieces of neighbouring anchors overlap, so they cover it all.

Sorting suffixes.  Pieces meet by anchor, and equal ones become one body with
several places.  The bodies of a chunk of whole anchor groups form one text.  Its
suffixes smaller than their successors are sorted directly, three words a step;
all others are induced by one scan over the buckets of first words, as a suffix
greater than its successor follows its successor's order.  Suffixes whose
common prefixes have `MIN_WORDS` words or more form a run of the suffix array;
all places of a run are marked if it has more than one.

An anchor at more than `HOT` places, as in a licence that a third of all documents
hold, isn't gathered in one task: each of its places gives the hashes of the windows
of 50 words whose own anchor it is, and windows that occur twice are marked by an
aggregation, which finds exactly what a suffix array of them would.

Marked places of a text are joined where they overlap or touch, and go to its owners.

Words are compared lower-cased, punctuation and white space are ignored.
Defined results: null, empty and short texts hold no passage; rows that repeat
both id and text count as one row; very long texts are cut up whole; ids keep
their type, and null ids are owners but never named as another document; an empty
table holds no passage; only id and text are read, whatever other columns are
called.  Ties: of the documents that share a window with a passage the one with
the smallest id is named, or its own if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import col, id_type, key_of, settled, written
from vellum.llm.textkit import POWERS, U64, gram_hashes, mix64, tidy, token_slices

MIN_WORDS, ANCHOR = 50, 20
_SPAN = MIN_WORDS - ANCHOR + 1  # hashes of which one is an anchor
_REACH = _SPAN - 1
#: Words of one chunk's text, unless a single anchor group has more.
CHUNK_WORDS = 400_000
#: Places of an anchor beyond which windows are counted instead.
HOT = 20_000


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each 20 words, and the same with its low bits made a place.

    Equal hashes in a window are told apart by place, so one is taken.
    """
    grams, low = gram_hashes(hashes, ANCHOR), U64((1 << 24) - 1)
    return grams, (grams & ~low) | (low - (np.arange(len(grams), dtype=U64) & low))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """Token index of the anchor of the 50 words from each token on."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, np.int64)
    low, begin = (1 << 24) - 1, np.arange(len(hashes) - MIN_WORDS + 1)
    place = low - (_sliding(_ordered(hashes)[1], _SPAN, np.minimum) & U64(low)).astype(np.int64)
    return begin + ((place - begin) & low)


def anchors(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token index and hash of every anchor."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams, value = _ordered(hashes)
    least = _sliding(value, _SPAN, np.minimum)
    least[row[: len(least)] != row[MIN_WORDS - 1 :]] = 0
    padded = np.concatenate([np.zeros(_REACH, U64), least, np.zeros(_REACH, U64)])
    at = np.flatnonzero(_sliding(padded, _SPAN, np.maximum) == value)
    return at, grams[at]


@tidy
def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, t in token_slices(batch.column(1)):
            at, grams = anchors(t.hash, t.row)
            row, size = t.row[at], np.diff(t.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), batch.column(0).take(pa.array(row + a)), pa.array((at - t.first[row]).astype(np.int32)), pa.array(size[row].astype(np.int32))], ["anchor", "key", "place", "n_words"]
            )


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, object]]:
    """Rows (key, text, a, b, places, anchors) slice by slice, with their tokens and anchors' places."""
    for a, b, t in token_slices(batch.column(1)):
        part = batch.slice(a, b - a)
        places = part.column(4)
        row = np.repeat(np.arange(b - a), pc.list_value_length(places).to_numpy())
        at = places.flatten().to_numpy().astype(np.int64) + t.first[row]
        yield part, row, at, part.column(5).flatten(), t.first[row], t.first[row + 1], t


@tidy
def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, row, at, groups, first, last, t in _cut(batch):
            begin, end = np.maximum(at - _REACH, first), np.minimum(at + ANCHOR + _REACH, last)
            cuts = np.concatenate([[0], np.cumsum(end - begin)])
            take = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], end - begin)
            words = (t.hash[take] >> U64(32)).astype(np.uint32)
            step = 1 << 14
            for s in range(0, len(at), step):
                e = min(s + step, len(at))
                offsets = ((cuts[s : e + 1] - cuts[s]) * 4).astype(np.int32)
                piece = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words[cuts[s] : cuts[e]]))])
                index = pa.array(row[s:e])
                yield pa.RecordBatch.from_arrays([groups.slice(s, e - s), part.column(0).take(index), part.column(2).take(index), part.column(3).take(index), pa.array((begin[s:e] - first[s:e]).astype(np.int64)), piece], ["anchor", "key", "a", "b", "start", "words"])


@tidy
def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, row, at, _, first, last, t in _cut(batch):
            # Each window has one anchor of its own, the least hash in it, and counts there.
            own = np.zeros(len(t.hash) + 1, dtype=bool)
            own[at] = True
            least = window_anchors(t.hash)
            start = np.flatnonzero((t.row[: len(least)] == t.row[MIN_WORDS - 1 :]) & own[least]) if len(least) else least
            owner = t.row[start]
            grams = gram_hashes(t.hash, MIN_WORDS)
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(grams[start].view(np.int64)), part.column(0).take(index), part.column(2).take(index), part.column(3).take(index), pa.array(start - t.first[owner])], ["window", "key", "a", "b", "start"])


def _pack(text: np.ndarray, at: np.ndarray, bits: int, words: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=U64)
    for i in range(words):
        out = (out << U64(bits)) | text[at + i].astype(U64)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of positive whole numbers whose last one is unique, in two stages."""
    n = len(text)
    following = np.append(text[1:], 0)
    differs = np.flatnonzero(text != following)
    decides = differs[np.searchsorted(differs, np.arange(n))]
    smaller = text[decides] < following[decides]

    # Stage one: sort the suffixes that are smaller than their successors.
    top = int(text.max())
    bits = 21 if top < 1 << 21 else 32
    words = 64 // bits
    padded = np.concatenate([text, np.zeros(words * 2, text.dtype)])
    at = np.flatnonzero(smaller)
    keys = _pack(padded, at, bits, words)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(at) else at
    depth = words
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(at) else at
    while len(tied):
        mine, deep = at[tied], np.minimum(at[tied] + depth, n)
        keys = _pack(padded, deep, bits, words)
        order = np.lexsort((keys, group[tied]))
        at[tied] = mine[order]
        keys, owner = keys[order], group[tied]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + len(group)
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        depth += words

    # Stage two: one scan over the buckets puts each larger suffix in its place.
    count = np.bincount(text, minlength=top + 2)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    small = np.bincount(text[at], minlength=top + 2)
    slots = np.full(n, -1, dtype=np.int64)
    first_small = start + count - small
    before = np.concatenate([[0], np.cumsum(small)[:-1]])
    slots[first_small[text[at]] + np.arange(len(at)) - before[text[at]]] = at
    sa, head, symbols, larger = slots.tolist(), start.tolist(), text.tolist(), (~smaller).tolist()
    last = n - 1  # the empty suffix is the least, so the last one is induced first
    if larger[last]:
        sa[head[symbols[last]]] = last
        head[symbols[last]] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and larger[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    return np.array(sa)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs; 0 where below `least`."""
    n = len(text)
    up, down = POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix64(text.astype(U64)) * up[:n], out=total[1:])

    def same(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (total[x + m] - total[x]) * down[x] == (total[y + m] - total[y]) * down[y]

    out = np.zeros(len(a), dtype=np.int64)
    room = n - np.maximum(a, b)
    maybe = np.flatnonzero(room >= least)
    maybe = maybe[same(a[maybe], b[maybe], np.full(len(maybe), least))]
    low, high = np.full(len(maybe), least), room[maybe]
    x, y = a[maybe], b[maybe]
    while (low < high).any():
        middle = (low + high + 1) // 2
        ok = same(x, y, middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    out[maybe] = low
    return out


def _two_least(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two least distinct numbers of each group that begins at `first`; a <= b."""
    least = np.minimum.reduceat(a, first)
    rest = np.where(a == np.repeat(least, np.diff(np.append(first, len(a)))), b, a)
    return least, np.minimum.reduceat(rest, first)


_NONE = np.iinfo(np.int64).max


def repeated_spans(key: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, ...]:
    """(place, start, end, least, next) of what repeats among some pieces.

    Numbers stand for texts (`key`) and for the two least ids of their owners, or
    _NONE.  `place` is the index of a piece; pieces of a text may overlap.
    """
    body = pc.dictionary_encode(pieces)
    owner, bodies = body.indices.to_numpy().astype(np.int64), body.dictionary
    order = np.argsort(owner, kind="stable")
    heads = np.searchsorted(owner[order], np.arange(len(bodies)))
    place = (key << 32) | start
    low, high = np.minimum.reduceat(place[order], heads), np.maximum.reduceat(place[order], heads)
    least, following = _two_least(heads, a[order], b[order])

    offsets = np.frombuffer(bodies.buffers()[1], dtype=np.int32)[bodies.offset : bodies.offset + len(bodies) + 1]
    words = np.frombuffer(bodies.buffers()[2], dtype=np.uint32)[offsets[0] // 4 : offsets[-1] // 4]
    size = np.diff(offsets) // 4
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text, whose = np.zeros(first[-1], dtype=np.int64), np.repeat(np.arange(len(bodies)), size + 1)
    ends = first[1:] - 1
    text[ends] = np.arange(1, len(bodies) + 1)
    inner = np.ones(len(text), dtype=bool)
    inner[ends] = False
    text[inner] = np.unique(words, return_inverse=True)[1] + len(bodies) + 1
    sa = suffix_array(text)
    full = first[whose[sa] + 1] - 1 - sa >= MIN_WORDS
    joined = np.zeros(len(sa), dtype=bool)
    joined[1:] = common_prefixes(text, sa[:-1], sa[1:], MIN_WORDS) > 0
    # Runs of suffixes with a common prefix of MIN_WORDS words, single ones too.
    at = np.flatnonzero(full)
    nothing = np.zeros(0, dtype=np.int64)
    if not len(at):
        return (nothing,) * 5
    suffix, new = sa[at], np.flatnonzero(~joined[at])
    mine = whose[suffix]
    offset = suffix - first[mine]
    length = np.diff(np.append(new, len(at)))
    several = np.minimum.reduceat(low[mine] + offset, new) != np.maximum.reduceat(high[mine] + offset, new)
    one, two = _two_least(new, least[mine], following[mine])
    hit = np.repeat(several, length)
    mine, offset, one, two = mine[hit], offset[hit], np.repeat(one, length)[hit], np.repeat(two, length)[hit]
    if not len(mine):
        return (nothing,) * 5

    # Marks of a body that overlap or touch become one before they go to its places.
    order_ = np.lexsort((offset, mine))
    mine, offset, one, two = mine[order_], offset[order_], one[order_], two[order_]
    new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (offset[1:] > offset[:-1] + MIN_WORDS)]))
    last = np.append(new[1:], len(mine)) - 1
    one, two = _two_least(new, one, two)
    mine, begin, end = mine[new], offset[new], offset[last] + MIN_WORDS
    copies = np.diff(np.append(heads, len(order)))[mine]
    each = np.repeat(np.arange(len(mine)), copies)
    piece = order[heads[mine][each] + np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)]
    return piece, start[piece] + begin[each], start[piece] + end[each], one[each], two[each]


def _spans_of(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    anchor, key, a, b, start, words = (table.column(i).combine_chunks() if isinstance(table.column(i), pa.ChunkedArray) else table.column(i) for i in range(6))
    number = pc.dictionary_encode(key).indices.to_numpy().astype(np.int64)
    # Numbers in the order of the ids, whatever their type.
    ids = pc.drop_null(pc.unique(pa.concat_arrays([a, b])))
    ids = ids.take(pc.array_sort_indices(ids))
    numbers = [pc.fill_null(pc.index_in(x, ids).cast(pa.int64()), _NONE).to_numpy() for x in (a, b)]
    piece, begin, end, one, two = repeated_spans(number, *numbers, start.to_numpy(), words)
    name = lambda x: ids.take(pa.array(np.where(x == _NONE, 0, x), mask=x == _NONE))
    return pa.RecordBatch.from_arrays([key.take(pa.array(piece)), pa.array(begin), pa.array(end), name(one), name(two)], ["key", "start", "end", "one", "two"])


@tidy
def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of whole anchor groups, of about CHUNK_WORDS words at a time."""
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        size = np.frombuffer(batch.column(5).buffers()[1], dtype=np.int32)[batch.column(5).offset : batch.column(5).offset + batch.num_rows + 1] // 4
        new = np.concatenate([[not held or held[-1].column(0)[-1].as_py() != anchor[0]], anchor[1:] != anchor[:-1]])
        done = 0
        for i in np.flatnonzero(new).tolist():
            if words + size[i] - size[done] >= CHUNK_WORDS:
                yield _spans_of(pa.Table.from_batches([*held, batch.slice(done, i - done)]))
                held, words, done = [], 0, i
        held.append(batch.slice(done))
        words += int(size[-1] - size[done])
    if held:
        yield _spans_of(pa.Table.from_batches(held))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, other_doc_id) of all repeated passages."""
    return settled(docs.sparkSession, lambda: _passages(docs, id_column, text_column))


def _passages(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    kind = id_type(docs, id_column)
    keyed = docs.select(key_of([text_column]).alias("key"), col(text_column).cast("string").alias("text"), col(id_column).alias("doc_id"))
    found = written(keyed.select("key", "text").mapInArrow(_anchor_batches, "anchor bigint, key binary, place int, n_words int"))
    # Only narrow numbers are shuffled, until each text that has repeated
    # anchors meets its list of them.
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = found.join(again, "anchor", "left_semi").select("anchor", "key", "place").distinct()
    twice = places.groupBy("anchor").agg((F.count("*") > HOT).alias("hot"), F.count("*").alias("n")).where("n > 1").drop("n")
    lists = written(places.join(twice, "anchor").groupBy("key", "hot").agg(F.collect_list(F.struct("place", "anchor")).alias("at")))

    rows = written(keyed.where("text is not null").groupBy("key", "doc_id").agg(F.lit(1).alias("n")).drop("n"))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n"))
    second = rows.join(least, "key").where("doc_id <> a").groupBy("key").agg(F.min("doc_id").alias("b"))
    owners = written(least.join(second, "key", "left"))
    wanted = lists.join(owners, "key")
    # By id, too, so that the rows of one text don't all go to one task.
    met = keyed.alias("d").join(wanted.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.a")))
    cut = met.select("d.key", "d.text", "w.a", "w.b", F.col("at.place").alias("places"), F.col("at.anchor").alias("anchors"), "hot")

    pieces = cut.where("not hot").drop("hot").mapInArrow(_piece_batches, f"anchor bigint, key binary, a {kind}, b {kind}, start bigint, words binary")
    spans = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_span_batches, f"key binary, start bigint, end bigint, one {kind}, two {kind}")
    if not lists.where("hot").isEmpty():
        # Not written on its own, so that texts are shuffled once for pieces and windows.
        windows = cut.where("hot").drop("hot").mapInArrow(_window_batches, f"window bigint, key binary, a {kind}, b {kind}, start bigint")
        # Rows that repeat give the same place again, which doesn't make it two.
        place = F.xxhash64("key", "start")
        one = windows.groupBy("window").agg(F.min("a").alias("one"), F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("window", "one")
        marked = windows.join(one, "window")
        two = marked.groupBy("window").agg(F.min(F.when(F.col("a") == F.col("one"), F.col("b")).otherwise(F.col("a"))).alias("two"))
        hot = marked.join(two, "window")
        spans = spans.unionByName(hot.select("key", "start", (F.col("start") + MIN_WORDS).alias("end"), "one", "two"))
    # A text with several owners is a passage as a whole.
    sizes = found.groupBy("key").agg(F.min("n_words").alias("n_words"))
    copied = owners.where("n > 1").join(sizes, "key").select("key", F.lit(0).cast("bigint").alias("start"), F.col("n_words").cast("bigint").alias("end"), F.col("a").alias("one"), F.col("b").alias("two"))
    spans = spans.unionByName(copied)

    by_place = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.withColumn("least", F.min("one").over(Window.partitionBy("key", "island")))
    joined = whole.groupBy("key", "island", "least").agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.min(F.when(F.col("one") == F.col("least"), F.col("two")).otherwise(F.col("one"))).alias("two"))
    named = rows.join(joined, "key")
    other = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("two")).otherwise(F.col("least"))
    return named.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), F.coalesce(other, "doc_id").alias("other_doc_id"))


PASSAGE_SQL = f"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM texts),
windows AS (
  SELECT doc_id, text, i - 1 AS start, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS gram
  FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM tokens WHERE len(w) >= {MIN_WORDS})),
firsts AS (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram HAVING count(*) > 1),
nexts AS (SELECT gram, least, min(doc_id) FILTER (WHERE doc_id <> least) AS following FROM windows JOIN firsts USING (gram) GROUP BY gram, least),
marks AS (
  SELECT doc_id, text, start, CASE WHEN doc_id IS DISTINCT FROM least THEN least ELSE following END AS other,
    CASE WHEN start > lag(start) OVER o + {MIN_WORDS} OR lag(start) OVER o IS NULL THEN 1 ELSE 0 END AS opens
  FROM windows JOIN nexts USING (gram) WINDOW o AS (PARTITION BY doc_id, text ORDER BY start)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, text ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM marks)
SELECT doc_id, min(start)::BIGINT AS start_word, (max(start) + {MIN_WORDS} - min(start))::BIGINT AS n_words, coalesce(min(other), doc_id) AS other_doc_id
FROM islands GROUP BY doc_id, text, island
"""
