"""SimHash near-duplicate groups by pigeonring filtering.

Every document gets a 256-bit SimHash of its distinct words.  A pair is near if
its Hamming distance is within MAX_DISTANCE, or if it is within WIDE_DISTANCE
and the sets of words have a Jaccard similarity of SIMILAR or more.  At that
similarity fingerprints of documents of like length differ in 44 bits on
average, with a standard deviation of 6, so the wide limit leaves two deviations
of room; unrelated short documents begin to come within it on large tables,
which is why words are compared there.

A *ring* is a permutation of the bits, cut into eight segments of 32.  By the
pigeonring principle two fingerprints within t bits have, on every ring, a start
from which each chain of l consecutive segments differs in at most l*t/8 bits; t
is WIDE_DISTANCE here.
The search looks for such starts: fingerprints meet at a start of a ring where
the first KEY_BITS bits agree, and from that very start the chain is followed
segment by segment.  A pair is dropped at the first chain beyond its budget, so
the segments after it are never compared; what gets through the chain of all
eight has passed the Hamming check.  A pair dropped at one start may still get
through at another.

Meeting by equal bits instead of all neighbours within the budget of a first
segment (three million values at seven of 32 bits) is where the search is approximate.
RINGS is chosen so that of isolated pairs, which no third copy can join, 0.9999
are found at 34 bits, 0.996 at 40, 0.96 at 44 and 0.77 at 50; nearer ones are
practically never missed, and those within 7 bits never.  Tests hold this.
On large tables keys are as wide as the binary logarithm of the number of
fingerprints, so that a fingerprint meets a bounded number of others by chance,
and there are more rings, so that the recall is the same at every size.

Within a set of fingerprints that meet, members are linked to leaders, and
leaders' followers are compared across until their sets are joined, so a set of
thousands of copies takes linear and not quadratic work.  Sets of more than
BLOCK members are compared block by block, each pair of blocks on its own, so
none has to fit into one task.  Nothing is capped.  Groups are the connected
components of the links.

Defined results: null or word-free text has no fingerprint and never groups;
rows with equal words always group; very long texts count with all their words;
of rows that repeat the same id and text one stays; null ids are allowed and
order first; ids keep their type; an empty table has no groups; other columns,
whatever their names, pass through.  Ties: of a group the row with the smallest
id, then the smallest key stays, and a bit that half of the words have is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.shared import col, content_key, fresh, id_type, settled, written
from vellum.llm.textkit import U64, binary_column, mix64, sorted_unique, tidy, token_slices

BITS, SEGMENTS, RINGS = 256, 8, 48
#: Bits of a key on tables of up to 2**KEY_BITS fingerprints.
KEY_BITS = 24
#: Most differing bits of near-duplicates whatever their words.
MAX_DISTANCE = 34
#: Most differing bits, and least Jaccard similarity, where words are compared.
WIDE_DISTANCE, SIMILAR = 56, 0.75

#: Rows of a run whose pairs are all compared.
SMALL_RUN = 16
#: Rows of a run that are compared in one piece.
BLOCK = 4096
#: Bits of a key's number, above which its ring and start stand.
_VALUE_BITS = 48

_SEEDS = mix64(np.arange(1, 5, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _permutation(ring: int) -> np.ndarray:
    return np.random.RandomState(ring).permutation(BITS) if ring else np.arange(BITS)


def layout(n: int, key_bits: int = KEY_BITS, rings: int = RINGS) -> tuple[int, int]:
    """Key bits and rings for n fingerprints: wider keys, and rings that make up for them."""
    wide = min(max(key_bits, ceil(log2(max(n, 1)))), _VALUE_BITS)
    agree = lambda bits: prod((BITS - MAX_DISTANCE - i) / (BITS - i) for i in range(bits))
    return wide, ceil(rings * agree(key_bits) / agree(wide))


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each group of consecutive rows; empty groups sum to zero."""
    out = np.zeros((len(first) - 1,) + rows.shape[1:], dtype=rows.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0)
    return out


def fingerprints_of(row: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes of SimHash over each row's distinct words, and their counts."""
    key = sorted_unique((row.astype(U64) << U64(44)) | (words >> U64(20)))
    row, key = (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1)
    count = np.bincount(row, minlength=n)
    # Byte counters hold up to 255 words: sum blocks first, then the blocks.
    blocks = -(-count // 255)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    word_first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(n), blocks)
    starts = word_first[owner] + 255 * (np.arange(len(owner)) - block_first[owner])
    sums = np.zeros((len(starts), BITS), dtype=np.uint8)
    step = 16  # blocks whose unpacked bits stay in the processor's cache
    for b in range(0, len(starts), step):
        lo = starts[b]
        hi = starts[b + step] if b + step < len(starts) else len(key)
        bits = np.unpackbits(mix64(key[lo:hi, None] ^ _SEEDS).view(np.uint8), axis=1, bitorder="little")
        sums[b : b + step] = np.add.reduceat(bits.view(U64), starts[b : b + step] - lo, axis=0).view(np.uint8)
    ones = _sums(sums.astype(np.int32), block_first)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little"), count


@tidy
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, tokens in token_slices(batch.column(2)):
            prints, count = fingerprints_of(tokens.row, tokens.hash, b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), binary_column(prints), pa.array(count, pa.int64())],
                ["doc_id", "key", "print", "n_words"],
            )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, print, n_words) of every row with at least one word."""
    source = docs.select(col(id_column).alias("doc_id"), content_key(docs, id_column, text_column).alias("key"), col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_fingerprint_batches, f"doc_id {id_type(docs, id_column)}, key binary, print binary, n_words bigint").where("n_words > 0")


def _rows_of(column: pa.Array) -> np.ndarray:
    """(n, 32) bytes of a column of fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def key_values(prints: np.ndarray, key_bits: int = KEY_BITS, rings: int = RINGS) -> np.ndarray:
    """(n, rings * SEGMENTS) keys: the first bits from each start of each ring, and which."""
    out = np.zeros((len(prints), rings, SEGMENTS), dtype=np.int64)
    bits = np.unpackbits(prints, axis=1)
    for r in range(rings):
        ring = np.packbits(np.take(bits, _permutation(r), axis=1), axis=1).view(">u4").astype(U64)
        value = ((ring << U64(32)) | np.roll(ring, -1, axis=1)) >> U64(64 - key_bits)
        out[:, r] = value.view(np.int64) | ((r * SEGMENTS + np.arange(SEGMENTS, dtype=np.int64)) << _VALUE_BITS)
    return out.reshape(len(prints), -1)


def _key_batches(key_bits: int, rings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = key_values(_rows_of(part.column(1)), key_bits, rings)
                yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), values.shape[1]))], ["segment", "node"])

    return run


def from_start(prints: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS) segments of fingerprints, in ring order from each one's start.

    `start` is ring * SEGMENTS + segment; equal ones stand together.
    """
    out = np.zeros((len(prints), BITS // 8), dtype=np.uint8)
    bits = np.unpackbits(prints, axis=1)
    cuts = np.concatenate([[0], np.flatnonzero(start[1:] != start[:-1]) + 1, [len(start)]]) if len(start) else [0]
    for s, e in zip(cuts[:-1], cuts[1:]):
        ring, segment = divmod(int(start[s]), SEGMENTS)
        order = np.roll(_permutation(ring), -segment * (BITS // SEGMENTS))
        out[s:e] = np.packbits(np.take(bits[s:e], order, axis=1), axis=1)
    return out.view(np.uint32)


def chained(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs whose chains from the first segment all stay within their budgets.

    Returns their places and distances, and how many pairs were left after each
    segment.  Segments after a broken chain are not looked at.
    """
    at, total, left = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), []
    for n in range(SEGMENTS):
        total = total + np.bitwise_count(a[at, n] ^ b[at, n])
        good = total * SEGMENTS <= (n + 1) * limit
        at, total = at[good], total[good]
        left.append(len(at))
    return at, total, left


def near(a: np.ndarray, b: np.ndarray, limit: int, wide: int) -> np.ndarray:
    """Which pairs get through the chains of `wide` from one start and lie within `limit`."""
    out, (at, total, _) = np.zeros(len(a), dtype=bool), chained(a, b, wide)
    out[at[total <= limit]] = True
    return out


def link_members(prints: np.ndarray, limit: int, wide: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all pairs that are `near` connect."""
    n, leader, leaders, links = len(prints), np.full(len(prints), -1), [], []
    left = np.arange(n)
    while len(left):
        head, rest = left[0], left[1:]
        leaders.append(head)
        leader[head] = head
        close = near(np.broadcast_to(prints[head], (len(rest), SEGMENTS)), prints[rest], limit, wide) if len(rest) else np.zeros(0, bool)
        leader[rest[close]] = head
        links += [(head, m) for m in rest[close]]
        left = rest[~close]
    # Leaders were compared with each other, so only sets with followers are left.
    joined = leader.copy()
    for h in np.flatnonzero(np.bincount(leader, minlength=n) > 1):
        for x in np.flatnonzero(leader == h):
            rest = np.flatnonzero(joined != joined[h])
            if not len(rest):
                break
            close = rest[near(np.broadcast_to(prints[x], (len(rest), SEGMENTS)), prints[rest], limit, wide)]
            sets, at = np.unique(joined[close], return_index=True)
            links += [(x, m) for m in close[at]]
            joined[np.isin(joined, sets)] = joined[h]
    return links


def doubtful_pairs(prints: np.ndarray, links: list[tuple[int, int]], wide: int) -> list[tuple[int, int]]:
    """All pairs within `wide` bits that the links leave in different sets."""
    joined = np.arange(len(prints))
    for a, b in links:
        joined[joined == joined[b]] = joined[a]
    out = []
    for x in range(len(prints)):
        rest = x + 1 + np.flatnonzero(joined[x + 1 :] != joined[x])
        if len(rest):
            close = near(np.broadcast_to(prints[x], (len(rest), SEGMENTS)), prints[rest], wide, wide)
            out += [(x, m) for m in rest[close]]
    return out


def _pairs_within(prints: np.ndarray, first: np.ndarray, limit: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within `wide` bits inside each run of rows.

    All of them where runs are small, as most are, runs of one size at once;
    elsewhere links for those within `limit` and what these leave apart.
    """
    size = np.diff(first)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SMALL_RUN + 1):
        begin, (i, j) = first[:-1][size == n], np.triu_indices(n, 1)
        step = max(1, 50_000 // len(i))
        for at in range(0, len(begin), step):
            x, y = ((begin[at : at + step, None] + k).ravel() for k in (i, j))
            close = near(prints[x], prints[y], wide, wide)
            a.append(x[close])
            b.append(y[close])
    for s, e in zip(first[:-1][size > SMALL_RUN], first[1:][size > SMALL_RUN]):
        links = link_members(prints[s:e], limit, wide)
        if wide > limit:
            links = links + doubtful_pairs(prints[s:e], links, wide)
        if links:
            x, y = np.array(links).T
            a.append(x + s)
            b.append(y + s)
    return np.concatenate(a), np.concatenate(b)


def _by_run(of_runs: Callable[[pa.Table], Iterator[pa.RecordBatch]], n_keys: int):
    """Apply `of_runs` to whole runs of equal keys, the first columns, of a sorted stream."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # A run may go on in the next batch.
            cut = int(_runs(batch, n_keys)[-2])
            if not cut and held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(n_keys)):
                held.append(batch)
                continue
            held.append(batch.slice(0, cut))
            yield from of_runs(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        if held:
            yield from of_runs(pa.Table.from_batches(held))

    return run


def _runs(table: pa.Table | pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where runs of equal values of the first columns begin, and the end."""
    new = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for i in range(n_keys):
        key = table.column(i).to_numpy()
        new |= key[1:] != key[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


def _met(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(segment, piece, node) of what meets; each pair of blocks of a large run is a piece."""
    first = _runs(table, 1)
    size = np.diff(first)
    segment, node = table.column(0).to_numpy(), table.column(1).to_numpy()

    def rows(at: np.ndarray, piece: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(segment[at]), pa.array(piece), pa.array(node[at])], ["segment", "piece", "node"])

    at = np.flatnonzero(np.repeat((size > 1) & (size <= BLOCK), size))
    yield rows(at, np.zeros(len(at), np.int64))
    for s, n in zip(first[:-1][size > BLOCK], size[size > BLOCK]):
        blocks = [np.arange(b, min(b + BLOCK, s + n)) for b in range(s, s + n, BLOCK)]
        for j in range(1, len(blocks)):
            for i in range(j):
                at = np.concatenate([blocks[i], blocks[j]])
                yield rows(at, np.full(len(at), j * (j - 1) // 2 + i, np.int64))


def _links(limit: int, wide: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        rings = from_start(_rows_of(table.column("print")), table.column("segment").to_numpy() >> _VALUE_BITS)
        a, b = _pairs_within(rings, _runs(table, 2), limit, wide)
        _, at = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0, return_index=True)
        a, b = a[at], b[at]
        sure = np.bitwise_count(rings[a] ^ rings[b]).sum(axis=1) <= limit
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(sure)], ["a", "b", "sure"])

    return run


def fingerprint_links(nodes: DataFrame, limit: int = MAX_DISTANCE, wide: int = WIDE_DISTANCE) -> DataFrame:
    """(a, b, sure) links between nodes (node bigint, print binary) that meet.

    All are within `wide` bits, and `sure` ones within `limit`.
    """
    # Two narrow numbers per key are shuffled; only what meets then gets its
    # fingerprint.
    pairs = nodes.mapInArrow(_key_batches(*layout(nodes.count())), "segment bigint, node bigint").repartition("segment").sortWithinPartitions("segment")
    met = pairs.mapInArrow(_by_run(_met, 1), "segment bigint, piece bigint, node bigint").join(nodes, "node").select("segment", "piece", "node", "print")
    sorted_runs = met.repartition("segment", "piece").sortWithinPartitions("segment", "piece", "node")
    return sorted_runs.mapInArrow(_by_run(_links(limit, max(limit, wide)), 2), "a bigint, b bigint, sure boolean").distinct()


@tidy
def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, tokens in token_slices(batch.column(1)):
            order = np.lexsort((tokens.hash, tokens.row))
            row, word = tokens.row[order], tokens.hash[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else np.zeros(0, np.int64)
            offsets = np.searchsorted(row[new], np.arange(b - a + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(word[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), words], ["node", "words"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The (a, b) of pairs whose texts (node, text) have similar sets of words."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    words = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_word_batches, "node bigint, words array<bigint>")
    sides = pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return sides.where(shared >= F.lit(similar) * (F.size("words_a") + F.size("words_b") - shared)).select("a", "b")


def near_duplicate_groups(docs: DataFrame, limit: int = MAX_DISTANCE, id_column: str = "doc_id", text_column: str = "text", wide: int = WIDE_DISTANCE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, key, group_id, group_size, keep, copies) of rows in groups of two or more.

    `group_id` is the smallest id of the group and `keep` marks its one row
    that stays: the smallest (doc_id, key).  `key` is `content_key` of the row;
    where rows repeat id and text they share a line here, with `copies` > 1.
    """
    return settled(docs.sparkSession, lambda: _groups(docs, limit, id_column, text_column, wide, similar))


def _groups(docs: DataFrame, limit: int, id_column: str, text_column: str, wide: int, similar: float) -> DataFrame:
    prints = written(fingerprints(docs, id_column, text_column))
    nodes = written(prints.groupBy("print").agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id()))
    links = written(fingerprint_links(nodes.select("node", "print"), limit, wide))
    doubtful = links.where("not sure").select("a", "b")
    # One row stands for all of the same fingerprint; texts are read again only
    # for the few nodes of doubtful pairs.
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "key")
    texts = docs.select(content_key(docs, id_column, text_column).alias("key"), col(text_column).cast("string").alias("text")).join(asked, "key").select("node", "text")
    label = components(links.where("sure").select("a", "b").union(similar_pairs(doubtful, texts, similar)))
    named = nodes.join(label, "node", "left").withColumn("group", F.coalesce("label", "node")).select("print", "group")
    rows = prints.groupBy("doc_id", "key", "print").agg(F.count("*").alias("copies"))
    grouped = rows.join(named, "print").select("group", F.struct("doc_id", "key").alias("row"), "copies")
    heads = grouped.groupBy("group").agg(F.min("row").alias("head"), F.sum("copies").alias("group_size")).where("group_size > 1")
    return grouped.join(heads, "group").select("row.doc_id", "row.key", F.col("head.doc_id").alias("group_id"), "group_size", (F.col("row") == F.col("head")).alias("keep"), "copies")


def keep_one_per_group(docs: DataFrame, limit: int = MAX_DISTANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table with one row of each near-duplicate group, columns unchanged."""
    groups = near_duplicate_groups(docs, limit, id_column, text_column)
    key, repeat = fresh(docs, "row_key"), fresh(docs, "row_copy")
    keyed = docs.withColumn(key, content_key(docs, id_column, text_column))

    def of(condition: str) -> DataFrame:
        # The key covers id and text, so it stands for the row.
        return groups.where(condition).select(F.col("key").alias(key)).distinct()

    kept = keyed.join(of("not keep or copies > 1"), key, "left_anti")
    if not groups.where("keep and copies > 1").isEmpty():
        again = keyed.join(of("keep and copies > 1"), key, "left_semi")
        others = [c for c in docs.columns if c not in (id_column, text_column)]
        window = F.row_number().over(_by(key, others))
        kept = kept.unionByName(again.withColumn(repeat, window).where(col(repeat) == 1).drop(repeat))
    return kept.drop(key)


def _by(key: str, others: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*[col(c).cast("string") for c in others] or [F.lit(1)])
