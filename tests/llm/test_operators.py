"""Corpus operators against SQL, brute force and defined results for odd rows."""

import itertools
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from oracle import same
from vellum.llm import classifier, decontaminate, langid, lines, mixing, queries, repetition, secrets, sharding, simhash, suffixes
from vellum.llm import textkit
from vellum.llm.textkit import gram_hashes, span_hashes, tokenize

SMALL = "/root/testdata/sf0.001"
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, KEY bigint, copy string, shard int, line string, node string, `a.b` string"


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing names."""
    rng = random.Random(1)
    long = " ".join(words(rng, 60_000))
    texts = [None, "", " ", "one", long, "\n\n", "same words here " * 30, "same words here " * 30]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", 1, "c", 2, "l", "n", "d") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[3], (None, "no id", None, None, None, None, None, None, None, None, None, None), (None,) * 12]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], SMALL)


# 1: sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation_and_inverse(n):
    place = sharding.permute(np.arange(n), n)
    assert sorted(place) == list(range(n))
    assert (sharding.permute(place, n, back=True) == np.arange(n)).all()
    assert sharding.row_at(int(place[n // 2]) % 4, int(place[n // 2]) // 4, n, 4) == n // 2


def test_sharding_odd_rows(spark, odd):
    out = sharding.sharded(odd, 4)
    assert out.columns[: len(odd.columns)] == odd.columns
    places = sorted(r[-1] * 4 + r[-2] for r in out.collect())
    assert places == list(range(odd.count()))
    assert sorted(r.place for r in sharding.assignments(odd).collect()) == places
    assert sharding.sharded(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart_by_all_columns(spark):
    rows = [(1, "same", f"s{i % 5}") for i in range(40)]
    for parts in (1, 3):
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
        got = sorted(map(tuple, sharding.sharded(docs, 4).collect()))
        assert len({r[3:] for r in got}) == 40
        assert parts == 1 or got == before
        before = got


def test_shards_are_written_by_as_many_tasks_as_they_ask_for(spark):
    docs = spark.range(4000).selectExpr("case when id % 3 = 0 then 0 else id end as doc_id", "'text' as text")
    out = sharding.sharded(docs, 8, task_rows=50)
    parts = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 80 and max(parts) <= 51
    assert sorted(r.slot * 8 + r.shard for r in out.collect()) == list(range(4000))


# 2: lines


def test_lines_brute_force(spark):
    rng = random.Random(2)
    pool = [f"boilerplate line number {i}" for i in range(40)]
    texts = ["\n".join(rng.sample(pool, 5) + [f"own line of {i}"]) for i in range(150)]
    sources = [f"site{rng.randrange(25)}" for _ in texts]
    spread = {x for x in pool if len({s for t, s in zip(texts, sources) if x in t.split("\n")}) >= 10}
    assert 0 < len(spread)
    want = {i: "\n".join(x for x in t.split("\n") if x not in spread) for i, t in enumerate(texts)}
    docs = frame(spark, texts, sources)
    assert {r.doc_id: r.text for r in lines.without_boilerplate(docs).collect()} == want


def test_lines_odd_rows(spark, odd):
    out = lines.without_boilerplate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == 2
    assert lines.without_boilerplate(odd.limit(0)).count() == 0


def test_line_on_just_as_many_sites_goes(spark):
    texts = ["a line for nine sites\na line for ten sites" if i < 9 else "A line for ten sites " for i in range(10)]
    out = lines.without_boilerplate(frame(spark, texts, [f"s{i}" for i in range(10)]), removed_column="n").collect()
    assert {r.text for r in out} == {"a line for nine sites", ""} and {r.n for r in out} == {1}


def test_text_of_many_lines_is_cut_once(spark):
    """A hundred thousand lines, every other one removed, in linear time."""
    long = "\n".join("shared boilerplate line" if i % 2 else f"own {i}" for i in range(100_000))
    docs = frame(spark, [long] + ["shared boilerplate line"] * 12, [f"s{i}" for i in range(13)])
    began = time.perf_counter()
    out = {r.doc_id: r.text for r in lines.without_boilerplate(docs).collect()}
    assert out[0].split("\n") == [f"own {i}" for i in range(0, 100_000, 2)] and set(list(out.values())[1:]) == {""}
    assert time.perf_counter() - began < 60


# 3: decontamination


def test_decontamination_brute_force(spark):
    rng = random.Random(3)
    items = [words(rng, n) for n in (1, 4, 12, 30, 55)]
    docs = [words(rng, 80) for _ in range(60)]
    for i, item in enumerate(items):
        docs[i] = docs[i][:20] + item + docs[i][20:]
        docs[10 + i] = item
    near = list(items[3])
    near[5], near[17] = "changed", "other"
    docs[20] = docs[20][:9] + near + docs[20][9:]
    docs[21] = docs[21][:9] + items[3][:12] + docs[21][9:]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id bigint, text string")
    found = {(r.item_id, r.doc_id): r.kind for r in decontaminate.matches(frame(spark, [" ".join(d) for d in docs]), benchmark).collect()}
    want = {(i, d): "exact" for i, t in enumerate(items) for d, x in enumerate(docs) if any(x[p : p + len(t)] == t for p in range(len(x)))}
    assert found == want | {(3, 20): "proximity"}
    kept = decontaminate.decontaminated(frame(spark, [" ".join(d) for d in docs]), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {d for _, d in found}


def test_decontamination_reports_every_place(spark):
    rng = random.Random(12)
    item, fill = words(rng, 20), [f"f{i}" for i in range(90)]
    near = ["changed" if i in (4, 11) else w for i, w in enumerate(item)]
    texts = [fill[:10] + item + fill[10:30] + near + fill[30:40] + item, item + item, near, fill[:3] + ["one"] + fill[3:5] + ["one"], ["a", "a", "a", "a", "a"]]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, "one"), (2, "a a")], "item_id bigint, text string")
    found = sorted((r.item_id, r.doc_id, r.position, r.kind) for r in decontaminate.matches(frame(spark, [" ".join(t) for t in texts]), benchmark).collect())
    assert found == [(0, 0, 10, "exact"), (0, 0, 50 - decontaminate.SLOP, "proximity"), (0, 0, 80, "exact"), (0, 1, 0, "exact"), (0, 1, 20, "exact"), (0, 2, 0, "proximity"), (1, 3, 3, "exact"), (1, 3, 6, "exact"), (2, 4, 0, "exact"), (2, 4, 2, "exact")]


def test_decontamination_odd_rows(spark, odd):
    benchmark = spark.createDataFrame([(1, "no id"), (1, "no id"), (None, None)], "item_id bigint, text string")
    out = decontaminate.decontaminated(odd, benchmark)
    assert out.columns == odd.columns and out.count() == odd.count() - 1
    assert decontaminate.decontaminated(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.decontaminated(odd.limit(0), benchmark).count() == 0


# 4: repetition


def test_repetition_odd_rows(spark, odd):
    out = repetition.repetition(odd)
    assert out.count() == odd.count() and repetition.repetition(odd.limit(0)).count() == 0
    verdict = {r.doc_id: r.keep for r in out.collect() if r.doc_id is not None}
    assert verdict[0] and verdict[1] and verdict[4] and not verdict[6]


# 5: repeated passages


def brute_passages(texts, least=50):
    """Word positions of each text that lie in a run of `least` words that recurs."""
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            where.setdefault(tuple(t[i : i + least]), []).append((d, i))
    return {(d, i + j) for places in where.values() if len(places) > 1 for d, i in places for j in range(least)}


def test_suffix_array_brute_force():
    rng = random.Random(5)
    for n, k in itertools.product((1, 2, 9, 200), (1, 2, 30)):
        text = np.array([rng.randint(2, k + 1) for _ in range(n)] + [1])
        assert suffixes.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def test_passages_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(40)]
    for _ in range(25):
        a, b, n = rng.randrange(40), rng.randrange(40), rng.choice((48, 49, 50, 51, 60, 130))
        at = rng.randrange(len(texts[a]) + 1)
        cut = rng.randrange(len(texts[b]) + 1)
        texts[b] = texts[b][:cut] + texts[a][at : at + n] + texts[b][cut:]
    docs = frame(spark, [" ".join(t) for t in texts])
    for hot, chunk in ((suffixes.HOT, suffixes.CHUNK_WORDS), (suffixes.HOT, 100), (2, 100)):
        monkeypatch.setattr(suffixes, "HOT", hot)
        monkeypatch.setattr(suffixes, "CHUNK_WORDS", chunk)
        found = suffixes.repeated_passages(docs).collect()
        got = {(r.doc_id, r.start_word + i) for r in found for i in range(r.n_words)}
        assert got == brute_passages(texts)


def test_passages_odd_rows(spark, odd):
    found = suffixes.repeated_passages(odd).collect()
    assert {r.doc_id for r in found} == {6, 7}
    assert suffixes.repeated_passages(odd.limit(0)).count() == 0


def test_passages_of_copies_name_the_least_other(spark):
    rng = random.Random(8)
    shared, alone = words(rng, 60), [words(rng, 70) for _ in range(4)]
    texts = [" ".join(t) for t in (alone[0], shared + alone[1], alone[2] + shared, shared, shared, alone[3] + alone[3])]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")))
    found = {tuple(r) for r in suffixes.repeated_passages(docs).collect()}
    assert found == {(1, 0, 60, 2), (2, 70, 60, 1), (3, 0, 60, 1), (4, 0, 60, 1), (None, 0, 60, 1), (5, 0, 140, 5)}


def test_copies_of_one_text_stay_linear(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(" ".join(f"w{i}" for i in range(200))).alias("text"))
    began = time.perf_counter()
    out = suffixes.repeated_passages(docs)
    assert out.where("start_word = 0 and n_words = 200 and other_doc_id = if(doc_id = 0, 1, 0)").count() == 100_000 == out.count()
    assert time.perf_counter() - began < 120


# 6: secrets


def test_secrets_equal_full_scan(spark):
    texts = ["key AKIA" + "A1B2" * 4, "password = 'hunter2hunter2'", "Token:\"abcdefgh\"", "nothing", "4" + "1" * 15, "f" * 40, "ftp://me:secret@host", None, "", "xoxb-" + "1" * 12 + " AKIA", "password='" + "x" * 500 + "'", "http://" + "u" * 90 + ":" + "p" * 90 + "@h"]
    got = {(r.doc_id, r.rule, r.start) for r in secrets.secrets(frame(spark, texts)).collect()}
    assert got == {(d, n, m.start()) for d, t in enumerate(texts) for n, p in secrets.RULES.items() for m in re.finditer(p, t or "", re.ASCII)}
    assert {r for _, r, _ in got} >= {"aws_access_key", "assigned_secret", "payment_card", "hex_key", "url_credentials", "slack_token"}


def test_secret_query_is_needed(spark, odd):
    without = {n for n, p in secrets.RULES.items() if secrets.trigram_query(p) is None}
    assert without == {"payment_card", "hex_key"}
    tri = lambda text: int.from_bytes(text.encode(), "big")
    assert secrets.trigram_query("xabc+") == tri("xab") and secrets.trigram_query("ab[cd]") == ("or", tri("abc"), tri("abd"))
    assert secrets.trigram_query("[0-9]{40}") is None
    assert secrets.secrets(odd).count() == 0 and secrets.secrets(odd.limit(0)).count() == 0


# 7: language


def brute_phrases(text, known):
    """Greedy longest-match phrases."""
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_phrases_brute_force():
    rng = random.Random(7)
    known = {k: bytes(rng.choice(b"abcd ") for _ in range(300)) for k in ("x", "y")}
    texts = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (0, 1, 5, 80, 300)]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.Parser(known).phrases(raw, offsets)
    assert got.tolist() == [[brute_phrases(t, known[k]) for k in ("x", "y")] for t in texts]


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 200")
    out = langid.identify(held, langid.training_text(fitted)).join(held.select("doc_id", "lang"), "doc_id")
    assert out.where("language = lang").count() >= 0.97 * out.count()


def test_training_takes_whole_texts(spark):
    short = [f"short{chr(97 + i)} text of this tongue" for i in range(20)]
    docs = frame(spark, ["over and over again " * 5000, *short])
    text = langid.training_text(docs)["en"].decode()
    assert text == "".join(" " + t for t in sorted(short))
    alone = langid.training_text(docs.where("doc_id = 0"))["en"].decode()
    assert alone == " " + "over and over again " * 5000


def test_long_text_is_parsed_in_pieces(monkeypatch):
    rng = random.Random(17)
    known = {k: bytes(rng.choice(b"abcd ") for _ in range(400)) for k in ("x", "y")}
    parser = langid.Parser(known)
    loose = bytes(rng.choice(b"abcd ") for _ in range(langid.PIECE * 5 + 77))
    for text in (loose, known["x"] * 60, b"ab" * 9000, loose[: 2 * langid.PIECE], b"e" * 20_000, loose + known["y"] * 40 + loose):
        raw = np.frombuffer(text, np.uint8)
        want = [brute_phrases(text, known[k]) for k in ("x", "y")]
        assert parser.phrases(raw, np.array([0, len(raw)])).tolist() == [want]
    texts = [loose, b"ab" * 9000, b"short", loose[5:], b"", known["x"] * 60, loose * 2]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(langid, "LANES", 12)
    want = [[brute_phrases(t, known[k]) for k in ("x", "y")] for t in texts]
    assert parser.phrases(raw, offsets).tolist() == want


def test_ten_million_bytes_take_seconds():
    rng = random.Random(18)
    parser = langid.Parser({k: bytes(rng.choice(b"abcdefgh ") for _ in range(5000)) for k in ("x", "y", "z")})
    raw = np.random.RandomState(0).choice(np.frombuffer(b"abcdefghij ", np.uint8), 10_000_000)
    began = time.perf_counter()
    parser.phrases(raw, np.array([0, len(raw)]))
    assert time.perf_counter() - began < 10


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(0, "same words", "zz"), (1, "same words", "aa"), (2, "same", None)], "doc_id int, text string, lang string")
    assert {r.language for r in langid.identify(docs, langid.training_text(docs)).collect()} == {"aa"}


def test_language_odd_rows(spark, odd):
    out = langid.identify(odd, langid.training_text(odd))
    assert out.count() == odd.count() and out.where("language is null").count() == 5
    none = odd.limit(0)
    assert langid.identify(none, langid.training_text(none)).count() == 0
    assert langid.identify(odd, {}).where("language is not null").count() == 0


# 8: quality


def test_classifier_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.fit(docs, labels.where("doc_id % 2 = 0"))
    held = classifier.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert held.where("keep = (quality = 1 and toxic = 0)").count() >= 0.93 * held.count()


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, None), (None, 1, 1), (99, 0, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    model = classifier.fit(odd, labels)
    out = classifier.accepted(odd, model)
    assert out.columns == odd.columns
    assert classifier.score(odd, model).count() == odd.count()
    assert classifier.accepted(odd, classifier.fit(odd, labels.limit(0))).count() == odd.count()
    assert classifier.accepted(odd.limit(0), model).count() == 0


def test_labels_without_text_leave_the_sample_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i < 10 else None) for i in range(15)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(15)] + [(1000 + i, 1, 0) for i in range(500)], "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, classifier.training_rows(docs, labels, limit=10).collect())) == [(f"text {i}", 2 * (i % 2)) for i in range(10)]
    assert classifier.training_rows(docs, labels, limit=4).count() == 4


def plain_features(text):
    """Buckets of a text, word by word in plain Python."""
    tokens = [(m.group(), bool(re.match(r"\w", m.group()))) for m in re.finditer(r"\w+|[^\w\s]+", text, re.ASCII)]
    hashed = lambda raw: int(span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    bucket = lambda h, salt: int(classifier._bucket(np.array([h % 2**64], np.uint64), salt)[0])
    out = []
    for token, _ in tokens:
        out.append(bucket(hashed(token.encode()), 1))
        framed = b"\x1f" + token.encode() + b"\x1f"
        for n in classifier.GRAMS:
            out += [bucket(int(gram_hashes(textkit._VALUE[np.frombuffer(framed[i : i + n], np.uint8)], n)[0]), 10 + n) for i in range(len(framed) - n + 1)]
    only = [t for t, w in tokens if w]
    for a, b in zip(only, only[1:]):
        out.append(bucket(3, 3) if a == b else bucket(hashed(a.encode()) * 0xD1342543DE82EF95 + hashed(b.encode()), 2))
    return out


def test_classifier_equals_plain_python(spark):
    texts, labels = ["Some good text, some more.", "bad bad bad", "toxic!! words here", "good words", ""], [0, 1, 2, 0, 1]
    examples = [classifier.shares_of(t) for t in texts]
    for text, (bucket, share) in zip(texts, examples):
        want = Counter(plain_features(text))
        assert bucket.tolist() == sorted(want)
        assert share.tolist() == pytest.approx([want[b] / sum(want.values()) for b in sorted(want)])
    # One epoch of the same steps with lists of numbers.
    rng = np.random.RandomState(3)
    prior = [(labels.count(c) + 1) / (len(labels) + 3) for c in range(3)]
    vectors = rng.uniform(-0.02, 0.02, (classifier.BUCKETS, classifier.WIDTH)).astype(np.float32)
    output = rng.uniform(-0.5, 0.5, (classifier.WIDTH, 3)).astype(np.float32).astype(float).tolist()
    bias, table = [math.log(p) for p in prior], {b: vectors[b].astype(float).tolist() for bucket, _ in examples for b in bucket.tolist()}
    wide = range(classifier.WIDTH)
    for i in rng.permutation(len(labels)):
        share = dict(zip(examples[i][0].tolist(), examples[i][1].tolist()))
        hidden = [sum(x * table[b][k] for b, x in share.items()) for k in wide]
        z = [sum(hidden[k] * output[k][c] for k in wide) + bias[c] for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        p = [v / sum(p) - (c == labels[i]) for c, v in enumerate(p)]
        back = [sum(output[k][c] * p[c] for c in range(3)) for k in wide]
        size = 1 + sum(h * h for h in hidden)
        output = [[output[k][c] - classifier.RATE * 0.1 * hidden[k] * p[c] / size for c in range(3)] for k in wide]
        bias = [bias[c] - classifier.RATE * 0.01 * p[c] for c in range(3)]
        norm = sum(x * x for x in share.values()) + 1e-9
        for b, x in share.items():
            table[b] = [table[b][k] - classifier.RATE / norm * x * back[k] for k in wide]
    logits, got_bias = classifier.train(examples, labels, epochs=1, seed=3)
    assert got_bias.tolist() == pytest.approx(bias, abs=1e-4)
    for b in table:
        assert logits[b].tolist() == pytest.approx([sum(table[b][k] * output[k][c] for k in wide) for c in range(3)], abs=1e-3)
    # And the scores of the model, added up bucket by bucket.
    out = {r.doc_id: r for r in classifier.score(frame(spark, texts), (logits, got_bias)).collect()}
    for i, text in enumerate(texts):
        buckets = plain_features(text)
        z = [sum(float(logits[b][c]) for b in buckets) / max(len(buckets), 1) + float(got_bias[c]) for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        assert out[i].clean == pytest.approx(p[0] / sum(p), abs=1e-5) and out[i].label == classifier.CLASSES[p.index(max(p))]


def test_classes_equally_probable_give_the_first(spark):
    model = (np.zeros((classifier.BUCKETS, 3), np.float32), np.zeros(3, np.float32))
    assert {r.label for r in classifier.score(frame(spark, ["a", "", None]), model).collect()} == {"clean"}


# 9: near duplicates


def near_corpus(seed=9):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        base = words(rng, 200)
        for _ in range(rng.choice((1, 1, 2, 3, 12))):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_recall(spark):
    texts = near_corpus()
    prints = {r.doc_id: np.frombuffer(r["print"], np.uint8) for r in simhash.fingerprints(frame(spark, texts)).collect()}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.MAX_DISTANCE}
    group = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, texts)).collect()}
    met = {p for p in pairs if p[0] in group and group[p[0]] == group.get(p[1])}
    assert len(pairs) > 100 and met == pairs


def isolated_pairs(distance, n=400, seed=0):
    """(2n, 32) fingerprints: each even row has one other within reach, the next."""
    rng = np.random.RandomState(seed)
    bits = np.repeat(rng.randint(0, 2, (n, simhash.BITS), dtype=np.uint8), 2, axis=0)
    for i in range(n):
        bits[2 * i + 1, rng.choice(simhash.BITS, distance, replace=False)] ^= 1
    return np.packbits(bits, axis=1, bitorder="little")


@pytest.mark.parametrize("distance, least", [(20, 1), (26, 1), (30, 1), (simhash.MAX_DISTANCE, 0.998), (40, 0.98), (44, 0.93), (50, 0.7)])
def test_near_duplicates_recall_of_isolated_pairs(spark, distance, least):
    prints = isolated_pairs(distance)
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node bigint, print binary")
    met = {(r.a, r.b): r.sure for r in simhash.fingerprint_links(nodes).collect()}
    assert set(met) <= {(i, i + 1) for i in range(0, len(prints), 2)} and len(met) >= least * len(prints) / 2
    assert set(met.values()) == {distance <= simhash.MAX_DISTANCE}


def test_keys_widen_with_the_table_and_recall_stays(monkeypatch):
    assert simhash.layout(1000) == simhash.layout(1 << 24) == (simhash.KEY_BITS, simhash.RINGS)
    bits, rings = simhash.layout(10**9)
    agree = lambda n: math.prod((256 - 34 - i) / (256 - i) for i in range(n))
    assert bits == 30 and rings * agree(30) >= simhash.RINGS * agree(24)
    prints = isolated_pairs(34, 200)
    keys = simhash.key_values(prints, bits, rings)
    assert np.mean([(keys[i] == keys[i + 1]).any() for i in range(0, 400, 2)]) >= 0.99


def rings_of(prints):
    return np.ascontiguousarray(prints).view(np.uint32)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.RandomState(1)
    for n in (2, 3, 20, 120):
        bits = rng.randint(0, 2, (4, simhash.BITS), dtype=np.uint8)[rng.randint(0, 4, n)] ^ (rng.random_sample((n, simhash.BITS)) < 0.065)
        prints = rings_of(np.packbits(bits.astype(np.uint8), axis=1, bitorder="little"))
        x, y = np.triu_indices(n, 1)
        close = simhash.near(prints[x], prints[y], 34, 56)
        labels = []
        for links in (list(zip(x[close], y[close])), simhash.link_members(prints, 34, 56)):
            label = list(range(n))
            for a, b in links:
                label = [label[a] if v == label[b] else v for v in label]
            labels.append([label.index(v) for v in label])
        assert labels[0] == labels[1]


def test_large_runs_are_compared_in_blocks(spark, monkeypatch):
    """The same groups when no run of more than a few rows is compared in one piece."""
    rng = np.random.RandomState(2)
    bits = rng.randint(0, 2, (3, simhash.BITS), dtype=np.uint8)[rng.randint(0, 3, 300)] ^ (rng.random_sample((300, simhash.BITS)) < 0.03)
    prints = np.packbits(bits.astype(np.uint8), axis=1)
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node bigint, print binary")
    labels = []
    for block in (simhash.BLOCK, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        label = list(range(300))
        for r in simhash.fingerprint_links(nodes).where("sure").collect():
            label = [label[r.a] if v == label[r.b] else v for v in label]
        labels.append([label.index(v) for v in label])
    assert labels[0] == labels[1] and len(set(labels[0])) == 3


def edited_pairs(rng, n, length, changed):
    """Texts of which each even one and the next share all but `changed` words."""
    texts = []
    for i in range(n):
        base = [f"b{i}x{j}" for j in range(length)]
        copy = [f"c{i}x{j}" for j in range(changed)] + base[changed:]
        texts += [" ".join(base), " ".join(rng.sample(copy, length))]
    return texts


def test_near_duplicates_by_planted_edits(spark):
    rng = random.Random(10)
    # Jaccard similarity 190/210, 180/220 and 13/27; unrelated texts besides.
    texts = edited_pairs(rng, 100, 200, 10) + edited_pairs(rng, 100, 200, 20) + edited_pairs(rng, 100, 20, 7)
    texts = [t.replace("b", f"p{i // 200}b").replace("c", f"p{i // 200}c") for i, t in enumerate(texts)]
    group = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(frame(spark, texts)).collect()}
    caught = [i for i in range(0, len(texts), 2) if i in group and group[i] == group.get(i + 1)]
    assert sum(i < 200 for i in caught) == 100 and sum(200 <= i < 400 for i in caught) >= 97
    assert max(group) < 400 and all(g in (i, i - 1) for i, g in group.items())


def test_some_start_keeps_every_near_pair():
    rng = np.random.RandomState(0)
    differ = np.zeros((3000, simhash.BITS), dtype=np.uint8)
    for row in differ:
        row[rng.choice(simhash.BITS, simhash.WIDE_DISTANCE, replace=False)] = 1
    prints, none = np.packbits(differ, axis=1), np.zeros((3000, 32), dtype=np.uint8)
    for ring in (0, 5):
        kept = np.zeros(3000, dtype=bool)
        for segment in range(simhash.SEGMENTS):
            start = np.full(3000, ring * simhash.SEGMENTS + segment)
            kept |= simhash.near(simhash.from_start(prints, start), simhash.from_start(none, start), simhash.WIDE_DISTANCE, simhash.WIDE_DISTANCE)
        assert kept.all()


def test_far_pairs_are_dropped_before_the_last_segments():
    """Of pairs that meet by chance few are compared beyond half of their segments."""
    rng = np.random.RandomState(4)
    a, b = (rng.randint(0, 256, (20_000, 32), dtype=np.uint8) for _ in range(2))
    b[:, :3] = a[:, :3]
    at, distance, left = simhash.chained(rings_of(a), rings_of(b), simhash.WIDE_DISTANCE)
    assert len(at) == left[-1] == 0 and left[1] < 2000 and left[3] < 20
    near = a.copy()
    near[:, 10] ^= 7
    at, distance, left = simhash.chained(rings_of(a), rings_of(near), simhash.WIDE_DISTANCE)
    assert left == [20_000] * 8 and set(distance) == {3}


def test_near_duplicates_odd_rows(spark, odd):
    out = simhash.keep_one_per_group(odd)
    assert out.columns == odd.columns
    kept = [r[0] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == [0, 1, 2, 3, 4, 5, 6] and kept.count(None) == 2
    assert simhash.keep_one_per_group(odd.limit(0)).count() == 0


# 10: mixing


def brute_levels(sizes, weights, caps, budget):
    clamped = {}
    while True:
        live = [s for s in sizes if s not in clamped]
        left, total = max(budget - sum(clamped.values()), 0), sum(weights[s] for s in live)
        over = {s: caps[s] for s in live if weights[s] * left / total > caps[s]} if total else {}
        if not over:
            return clamped | {s: weights[s] * left / total for s in live}
        clamped |= over


def test_mixing_brute_force(spark):
    sizes, weights = {"a": 100, "b": 1000, "c": 5000, "d": 40}, {"a": 10, "b": 10, "c": 10, "d": 70}
    rows = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, size bigint, weight bigint")
    got = {r.source: r.epochs * r.size for r in mixing.epochs(rows).collect()}
    assert got == pytest.approx(brute_levels(sizes, weights, {s: 4 * n for s, n in sizes.items()}, sum(sizes.values())))
    with pytest.raises(ValueError):
        mixing.with_weights(rows, rows.selectExpr("source", "-1 as weight"))


def test_mixing_odd_rows(spark, odd):
    out = mixing.mixed(odd, mixing.epochs(mixing.source_sizes(odd)))
    assert out.columns == odd.columns and out.count() > 0
    none = odd.limit(0)
    assert mixing.mixed(none, mixing.epochs(mixing.source_sizes(none))).count() == 0


def test_tokens_are_those_of_a_regular_expression():
    text = "Ab_c 1-é2 x".lower()
    raw = np.frombuffer(text.encode(), np.uint8)
    t = tokenize(raw, np.array([0, len(raw)]))
    assert [raw[s:e].tobytes().decode() for s, e in zip(t.start, t.end)] == re.findall(r"[0-9a-z_\u0080-￿]+", text)


# all


def test_ids_keep_their_type(spark):
    """Ids of web corpora are addresses."""
    rng = random.Random(20)
    base = [" ".join(words(rng, 80)) for _ in range(6)]
    texts = [*base, base[0], base[1] + " more", "key AKIA" + "A1B2" * 4, None]
    docs = spark.createDataFrame([(f"http://s{i % 3}/{i}", t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id string, text string, lang string, source string")
    labels = spark.createDataFrame([("http://s0/0", 1, 0), ("http://s1/1", 0, 0)], "doc_id string, quality int, toxic int")
    benchmark = spark.createDataFrame([("item", base[2])], "item_id string, text string")
    assert {r.doc_id for r in sharding.assignments(docs).collect()} == {r.doc_id for r in docs.collect()}
    assert sharding.sharded(docs).count() == lines.without_boilerplate(docs).count() == repetition.repetition(docs).count() == 10
    assert [(r.item_id, r.doc_id) for r in decontaminate.matches(docs, benchmark).collect()] == [("item", "http://s2/2")]
    found = {(r.doc_id, r.other_doc_id) for r in suffixes.repeated_passages(docs).collect()}
    assert found == {("http://s0/0", "http://s0/6"), ("http://s0/6", "http://s0/0"), ("http://s1/1", "http://s1/7"), ("http://s1/7", "http://s1/1")}
    assert [r.doc_id for r in secrets.secrets(docs).collect()] == ["http://s2/8"]
    assert langid.identify(docs, langid.training_text(docs)).where("doc_id = 'http://s0/0'").count() == 1
    assert classifier.score(docs, classifier.fit(docs, labels)).where("doc_id = 'http://s0/0'").count() == 1
    assert {(r.doc_id, r.group_id) for r in simhash.near_duplicate_groups(docs).collect()} == {("http://s0/0", "http://s0/0"), ("http://s0/6", "http://s0/0"), ("http://s1/1", "http://s1/1"), ("http://s1/7", "http://s1/1")}
    assert mixing.mixed(docs, mixing.epochs(mixing.source_sizes(docs))).count() > 0


def test_ties(spark):
    share = "a b c d e f g h i j " * 1
    assert {r.doc_id: r.keep for r in repetition.repetition(frame(spark, ["line one\nline two x\n" * 1, share])).collect()} == {0: True, 1: True}
    hit = secrets.secrets(frame(spark, ["AKIA" + "A" * 16 + " AKIA" + "A" * 16])).collect()
    assert [(r.occurrence, r.start) for r in sorted(hit)] == [(1, 0), (2, 21)]
    groups = simhash.near_duplicate_groups(frame(spark, ["same words"] * 3)).collect()
    assert {(r.doc_id, r.group_id, r.keep) for r in groups} == {(0, 0, True), (1, 0, False), (2, 0, False)}
    a, b = "one two three four five", "one two three four other"
    benchmark = spark.createDataFrame([(0, a)], "item_id bigint, text string")
    places = decontaminate.matches(frame(spark, [a + " " + a, b + " " + a]), benchmark).collect()
    assert sorted((r.doc_id, r.kind, r.position) for r in places if r.kind == "exact") == [(0, "exact", 0), (0, "exact", 5), (1, "exact", 5)]


def test_tables_on_the_way_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    docs = frame(spark, ["some words here\nand a second line"] * 3 + [" ".join(map(str, range(60)))] * 2)
    benchmark = spark.createDataFrame([(0, "some words here and")], "item_id bigint, text string")
    before = set(os.listdir(folder))
    results = [suffixes.repeated_passages(docs), simhash.near_duplicate_groups(docs), decontaminate.matches(docs, benchmark), mixing.epochs(mixing.source_sizes(docs)), lines.boilerplate(docs)]
    assert all(r.collect() is not None for r in results)
    assert len(set(os.listdir(folder)) - before) == len(results)
