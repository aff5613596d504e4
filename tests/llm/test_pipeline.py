"""The pipeline against the same stages by brute force on a small corpus."""

import itertools
import random
import re

import numpy as np

import corpus_pipeline
from test_operators import ODD, words
from vellum.llm import classifier, mixing, sharding, simhash


def write(spark, folder, docs, labels, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "source mixing", "sharding"]


def test_pipeline_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(60, 150))) for _ in range(60)]
    texts += [" ".join(rng.choice(("vile", "filth", "scum")) for _ in range(80)) + f" r{i}" for i in range(12)]
    texts += [texts[0], texts[1] + " extra", texts[2]]
    item = words(rng, 14)
    texts[5] += " " + " ".join(item)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 1 if 60 <= i < 72 else 0) for i in range(0, 75, 2)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    sf = write(spark, tmp_path, docs, labels, benchmark)

    verdict = {r.doc_id: r.keep for r in classifier.score(docs, classifier.fit(docs, labels)).collect()}
    assert [d for d in verdict if not verdict[d]] == list(range(60, 72))
    kept = [d for d in range(75) if verdict[d]]
    prints = {r.doc_id: np.frombuffer(r["print"], np.uint8) for r in simhash.fingerprints(docs).collect()}
    for a, b in itertools.combinations(list(kept), 2):
        if a in kept and b in kept and np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.MAX_DISTANCE:
            kept.remove(b)
    assert not {72, 73, 74} & set(kept)
    kept = [d for d in kept if " ".join(item) not in texts[d]]
    assert 5 not in kept
    sizes = {f"s{i}": sum(len(texts[d]) for d in kept if d % 4 == i) for i in range(4)}
    weights = {s: int(1000 * n**0.5) for s, n in sizes.items()}
    level = sum(sizes.values()) / sum(weights.values())
    times = {}
    for d in kept:
        passes = min(weights[f"s{d % 4}"] * level, 4 * sizes[f"s{d % 4}"]) / sizes[f"s{d % 4}"]
        import hashlib

        drawn = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32
        times[d] = int(passes) + (drawn < passes - int(passes))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert {d: sum(r.doc_id == d for r in rows) for d in kept} == times and len(rows) == sum(times.values())
    assert sorted(r.slot * sharding.SHARDS + r.shard for r in rows) == list(range(len(rows)))
    ordered = sorted(d for d in times for _ in range(times[d]))
    place = sharding.permute(np.arange(len(ordered)), len(ordered))
    assert sorted((d, int(p)) for d, p in zip(ordered, place)) == sorted((r.doc_id, r.slot * sharding.SHARDS + r.shard) for r in rows)


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(i, t, "en", "s", 3, "k", 1, "c", 2, "l", "n", "d") for i, t in enumerate([None, "", "one two", "one two", "x " * 30_000])] + [(None,) * 12]
    odd = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, None)], "item_id bigint, text string")
    for n, docs in enumerate((odd, odd.limit(0))):
        sf = write(spark, tmp_path / str(n), docs, labels, benchmark)
        out = corpus_pipeline.run(spark, sf)
        assert out.columns[:12] == odd.columns and len(out.columns) == 14
        out.collect()
    assert not re.search("limit", open(corpus_pipeline.__file__).read())
