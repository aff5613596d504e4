import hashlib
import json
import math
import re
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.__main__ import main
from vellum.engine import Engine
from vellum.operators import content
from vellum.operators.memory import ConversationMemory, as_text, context_query, folded
from vellum.sources import connectors, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("kb")
    for name, text in {"billing/pricing.md": "# Pricing\nThe standard plan costs 49 dollars each month.", "billing/refunds.txt": "Refunds are paid within thirty days.", "eng/_arch.MD": "Services talk through a message queue.", ".git/x.md": "hidden", "node_modules/y.md": "hidden"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine.open(spark, str(tmp_path_factory.mktemp("catalogue")))
    e.first = e.add_path(str(folder), "kb").build()
    return e


def test_build_search_and_rebuild(engine, folder):
    assert engine.first == {"indexed": 3, "skipped": 0, "failed": 0, "chunks": 3}
    found = engine.search("how much is the standard plan?", k=3)
    assert found[0]["title"] == "pricing.md" and "49 dollars" in engine.context("standard plan price")
    assert engine.context("standard plan").startswith("[1] ")
    assert engine.search("   ") == []
    assert engine.stats()["by_type"]["folder_rollup"] >= 2
    assert engine.add_path(str(folder), "kb").build()["skipped"] == 3


def test_versions_and_sections(engine, folder, spark):
    page = folder / "billing/pricing.md"
    page.write_text(page.read_text().replace("49", "59"))
    assert engine.add_path(str(folder), "kb").build()["indexed"] == 1
    now = " ".join(r["excerpt"] for r in engine.search("standard plan dollars", include_chunks=True))
    assert "59 dollars" in now and "49 dollars" not in now
    old = " ".join(r["excerpt"] for r in engine.search("standard plan dollars", include_chunks=True, include_archived=True))
    assert "49 dollars" in old
    versions = engine.store.read("versions")
    assert versions.where("is_current").count() == 3 and versions.count() == 4
    section = engine.create_section("Money")
    doc = engine.store.read("documents").where("uri like '%pricing%'").first()["doc_id"]
    engine.assign(doc, section)
    engine.rebuild_rollups()
    assert engine.stats()["by_type"]["section_rollup"] == 1
    assert Engine.open(spark, engine.config.root).stats() == engine.stats()
    engine.delete(doc)
    assert engine.stats()["documents"] == 2
    engine.store.vacuum()
    assert engine.stats()["documents"] == 2


def test_failing_sources_stay_apart(engine):
    def broken():
        raise OSError("no such place")

    counts = engine.add_source(broken).add_text("All staff get leave in August.", "leave").build()
    assert counts["failed"] == 1 and counts["indexed"] == 1


def test_tables_tool_and_command_line(spark, tmp_path, capsys):
    with sqlite3.connect(tmp_path / "shop.db") as db:
        db.execute("CREATE TABLE customers (id INTEGER, name TEXT, email TEXT)")
        db.executemany("INSERT INTO customers VALUES (?, ?, ?)", [(i, f"Name {i}", f"n{i}@example.com") for i in range(20)])
    e = Engine.open(spark, str(tmp_path / "cat"))
    assert e.add_sql(str(tmp_path / "shop.db")).build()["indexed"] == 1
    row = e.store.read("documents").first()
    assert row["modality"] == "tabular" and row["metadata"]["row_count"] == "20"
    tool = e.as_tool()
    assert json.loads(tool.run_json("customers email"))["evidence"]
    assert tool.chat_schema()["function"]["parameters"] == tool.messages_schema()["input_schema"] == tool.responses_schema()["parameters"]
    assert main(["--root", str(tmp_path / "cat"), "stats"], spark) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 1


def test_streaming_intake(spark, tmp_path):
    from vellum.streaming.intake import build_stream

    for i in range(2):
        connectors.from_text(spark, f"Note number {i} about rivers.", f"n{i}").write.mode("append").parquet(str(tmp_path / "in"))
    e = Engine.open(spark, str(tmp_path / "cat"))
    stream = spark.readStream.schema(connectors.ASSETS).parquet(str(tmp_path / "in"))
    build_stream(e, stream, str(tmp_path / "cp")).awaitTermination()
    assert e.stats()["documents"] == 2


def test_crawl_of_pages(spark):
    link = '<a href="{}">x</a>'
    pages = spark.createDataFrame([("https://www.a.org", link.format("/b") + link.format("https://other.net/")), ("https://www.a.org/b?x=1", "<nav>menu</nav>Hello" + link.format("c")), ("https://www.a.org/c", "<script>x()</script>World"), ("https://other.net/", "away")], "url string, html string")
    found = {r["url"]: (r["text"], r["depth"]) for r in connectors.crawl(pages, "https://www.a.org/b").collect()}
    assert found == {"https://www.a.org/": ("x x", 0), "https://www.a.org/b": ("Hello x", 1), "https://www.a.org/c": ("World", 2)}
    assert connectors.crawl(pages, "https://www.a.org", max_pages=1).count() == 1
    assert not connectors.is_public("localhost") and not connectors.is_public("x", lambda _: ["10.0.0.1"]) and connectors.is_public("x", lambda _: ["8.8.8.8"])


def test_readers():
    assert readers.REGISTRY.parse("a.csv", b"a,b\n1,2\n") == [("table", "a | b\n1 | 2", "a.csv")]
    assert readers.REGISTRY.parse("a.html", b"<p>Hello</p><script>x()</script>") == [("text", "Hello", "a.html")]
    assert readers.REGISTRY.parse("a.zzz", b"plain") == [("text", "plain", "a.zzz")]
    assert readers.REGISTRY.parse("a.pdf", b"plain") == []


def test_chunks_equal_packing(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 74, 75, 76, 140, 500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for got, text in zip(df.select(content.chunk_texts("text", 100, 20)).collect(), texts):
        assert got[0] == [c["text"] for c in content.pack_blocks([("text", text, "x")], 100, 20)]


def test_memory_equals_running_memory(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * (40 * i)) for i in range(12)]
    running = ConversationMemory(4)
    for _, _, role, text in turns:
        running.add(role, text)
    whole = folded(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), 4)
    assert whole.first()["summary"] == running.summary and len(running.turns) == 4
    assert context_query(whole, F.lit("next?")).first()["context_query"] == running.context_query("next?")
    assert as_text(whole).first()["text"] == running.as_text()


def test_profile_types():
    p = content.python_profile([("table", "id | name | email | active\n1 | A | a@x.org | true\n2 | B | b@x.org | false", "t")], "csv")
    assert (p["modality"], p["row_count"]) == ("tabular", 2)
    assert [c["inferred_type"] for c in p["columns"]] == ["number", "category", "email", "boolean"]
    assert content.python_profile([("text", "  ", "t")])["modality"] == "empty"


def test_whole_chunking_of_several_blocks():
    """Packing in order, the carried tail, joined locations and headings."""
    blocks = [("heading", "Title line\nmore", "p.1"), ("text", " ".join(f"a{i}" for i in range(40)), "p.1"), ("text", " ".join(f"b{i}" for i in range(40)), "p.2"), ("slide", "", "p.3"), ("page", " ".join(f"c{i}" for i in range(200)), "p.4")]
    got = content.pack_blocks(blocks, 80, 20)
    assert got[0]["heading"] == "Title line" and got[0]["location"] == "p.1"
    for a, b in zip(got, got[1:]):
        assert b["text"].split()[:15] == a["text"].split()[-15:]
    assert got[1]["location"] == "p.1 - p.2" and got[-1]["location"] == "p.4" and got[-1]["heading"] == "Page"
    assert [c["index"] for c in got] == list(range(len(got))) and all(c["token_count"] <= 80 + 27 for c in got)


def test_chunking_takes_time_in_proportion():
    import time

    import pyarrow as pa

    from vellum.functions import tokens

    def seconds(n):
        text, took = pa.array([" ".join(f"w{i}" for i in range(n))]), []
        for _ in range(3):
            began = time.perf_counter()
            tokens.windows(text, 600, 600, 60)
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(1_200_000) < 12 * seconds(300_000)


def test_windows_of_odd_texts():
    import pyarrow as pa

    from vellum.functions import tokens

    rows = [None, "", "  　", " one two\u0085three four  ", "a b c d e f g", "é" * 9, "x\ty\n\nz " * 5]
    for win, back in ((3, 1), (2, 0), (600, 60)):
        got = tokens.windows(pa.array(rows), win, win, back).to_pylist()
        for text, chunks in zip(rows, got):
            words = (text or "").split()
            want = [] if not words else [text.strip()] if len(words) <= win else []
            if len(words) > win:
                at = 0
                while True:
                    tail = " ".join(words[at - (win - back) + win - back : at - (win - back) + win]) + "\n\n" if at and back else ""
                    want.append(tail + " ".join(words[at : at + win]))
                    if at + win >= len(words):
                        break
                    at += win - back
            assert chunks == want


def test_tokens_are_those_of_the_expressions():
    import random
    import re

    import pyarrow as pa

    from vellum.functions import tokens

    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ9_- -é中²ß.\n—'x\0") for _ in range(rng.randrange(40))) for _ in range(2000)] + [None, "", "foo-barß", "a--", "9-abc"]
    for keywords, pattern in ((True, r"\b[a-zA-Z][a-zA-Z0-9_\-]{2,}\b"), (False, r"\b[a-zA-Z0-9][a-zA-Z0-9_\-]*\b")):
        t = tokens.tokens_of(*tokens.code_points(pa.array(texts)), keywords)
        words, got = t.words.to_pylist(), [[] for _ in texts]
        for r, w in zip(t.row, t.word):
            got[r].append(words[w])
        assert got == [[x.lower() for x in re.findall(pattern, s or "")] for s in texts]


def test_digests_are_md5():
    import hashlib

    import pyarrow as pa

    from vellum.functions import tokens

    texts = ["", "a", "é", *("x" * n for n in (55, 56, 63, 64, 119, 120, 500))]
    assert tokens.md5_words(pa.array(texts)).astype("<u4").tobytes() == b"".join(hashlib.md5(t.encode()).digest()[:8] for t in texts)


def test_models_summarize_and_embed(spark, tmp_path):
    from vellum.operators import models

    def complete(title, text):
        if text.startswith("This one"):
            raise OSError("no answer")
        return f"Summary of {title}."

    e = Engine.open(spark, str(tmp_path / "cat"), embed=models.model_embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2), summarize=models.model_summarizer(complete))
    e.add_text("All is well.", "one").add_text("This one fails.", "two").build()
    assert {r["title"]: r["summary"] for r in e.items().collect()} == {"one.txt": "Summary of one.txt.", "two.txt": "This one fails."}
    assert {len(r["vector"]) for r in e.records.all_records().collect()} == {2}
    assert "Summary of /" in e.records.all_records().where("doc_type = 'folder_rollup'").first()["text"]


class TableRecords:
    """A store of one's own that keeps its records in memory."""

    def __init__(self, spark):
        self.spark, self.rows, self.calls = spark, None, []

    def all_records(self):
        from vellum.sources.store import SCHEMAS

        return self.spark.createDataFrame(self.rows or [], SCHEMAS["records"])

    def _keep(self, df):
        self.rows = [tuple(r) for r in df.collect()]

    def upsert(self, records):
        self._keep(self.all_records().join(records.select("id"), "id", "left_anti").unionByName(records))

    def delete_documents(self, docs):
        self.calls.append("delete_documents")
        self._keep(self.all_records().join(docs, "doc_id", "left_anti").select(*self.all_records().columns))

    def persist(self):
        pass

    def close(self):
        self.calls.append("close")


def test_store_without_editions_deletes_them(spark, tmp_path):
    from vellum.sources.backends import RecordStore, implements, keeps_editions

    class Stub(RecordStore):
        pass

    class Delegating:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

    store = TableRecords(spark)
    e = Engine.open(spark, str(tmp_path / "cat"), records=store)
    assert not e.archives and not keeps_editions(Stub()) and not implements(Stub(), "archive")
    assert keeps_editions(Delegating(Engine.open(spark, str(tmp_path / "other")).records))
    given = TableRecords(spark)
    given.archive = given.delete_editions = lambda df: None
    assert keeps_editions(given)
    e.add_text("The plan costs 49 dollars.", "plan").build()
    e.add_text("The plan costs 59 dollars.", "plan").build()
    texts = " ".join(r["text"] for r in e.records.all_records().collect())
    assert "59 dollars" in texts and "49 dollars" not in texts and "delete_documents" in store.calls
    assert e.search("plan dollars", include_chunks=True)[0]["excerpt"]
    e.close()
    assert store.calls[-1] == "close"


def test_flat_backend_filters_afterwards(spark, tmp_path):
    from vellum.operators.search import Filters, embedded

    e = Engine.open(spark, str(tmp_path / "cat"), backend="flat")
    for i in range(12):
        e.add_text(f"river number {i}", f"n{i}", source_id="a" if i < 11 else "b")
    e.build()
    asked = embedded(spark.createDataFrame([(0, "river number 3")], "query_id bigint, query string"))
    assert e.records.search_semantic(asked, 2).orderBy("rank").first()["id"]
    assert e.records.search_semantic(asked, 1, Filters(source_ids=("b",))).count() <= 1
    assert e.search("river number 3")[0]["title"] == "n3.txt"


def test_catalogue_verbs(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "cat"))
    e.add_text(" ".join(f"word{i}" for i in range(1500)), "long").build()
    doc = e.catalogue.all_documents().first()
    now = e.catalogue.get_current_version(doc["doc_id"])
    assert e.catalogue.get_document(doc["doc_id"])["title"] == "long.txt" and e.catalogue.get_document("none") is None
    assert e.catalogue.get_version(doc["doc_id"], now["version_id"]) == now and e.catalogue.get_version(doc["doc_id"], "x") is None
    assert [r["idx"] for r in e.catalogue.get_chunks(doc["doc_id"], now["version_id"]).collect()] == [0, 1, 2]
    e.catalogue.set_version_flags(doc["doc_id"], now["version_id"], embedded=False, other=True)
    assert not e.catalogue.get_current_version(doc["doc_id"])["embedded"]
    section = e.catalogue.upsert_section("Long ones", "texts")
    e.catalogue.assign_membership(doc["doc_id"], section, 0.5, "size")
    assert e.catalogue.sections_of(doc["doc_id"]) == [section] and e.catalogue.documents_of(section) == [doc["doc_id"]]
    assert e.catalogue.all_sections().first()["description"] == "texts"
    e.catalogue.mark_deleted(doc["doc_id"])
    assert e.catalogue.all_documents().count() == 0 and e.catalogue.all_documents(include_deleted=True).count() == 1


def test_unchanged_build_writes_no_records(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "cat"))
    e.add_text("Some text.", "one").build()
    before = e.store.pointer()
    assert e.add_text("Some text.", "one").build()["skipped"] == 1
    after = e.store.pointer()
    assert {k for k in after if after[k] != before[k]} == {"rollups"}
    import os

    assert not [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.startswith("staged-")]


def test_errors_of_sources_are_kept(spark, tmp_path):
    def broken():
        raise OSError("no such place")

    e = Engine.open(spark, str(tmp_path / "cat"))
    assert e.add_source(broken).build()["failed"] == 1 and "no such place" in e.errors[0]


def test_object_store_paths(spark, tmp_path):
    for name, text in {"a.txt": "alpha", "sub/b.md": "beta", "node_modules/c.md": "no", "d.zzz": "no"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    for path in (f"file://{tmp_path}/in", f"{tmp_path}/in/"):
        found = connectors.from_binary_files(spark, path).collect()
        assert {(r["name"], bytes(r["data"]).decode()) for r in found} == {("a.txt", "alpha"), ("sub/b.md", "beta")}


def test_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(30)])
    db.commit()

    class Pool:
        def raw_connection(self):
            return sqlite3.connect(tmp_path / "x.db")

    want = None
    for given in ({"path": str(tmp_path / "x.db")}, {"connection": db}, {"engine": Pool()}):
        rows = connectors.sql_tables(spark, sample_rows=3, **given).collect()
        assert len(rows) == 1 and rows[0]["metadata"]["row_count"] == "30" and bytes(rows[0]["data"]).count(b"v") == 3
        want = want or rows
        assert rows == want
    assert db.execute("SELECT count(*) FROM t").fetchone() == (30,)
    assert connectors.sql_tables(spark, connection=db, tables=["none"]).count() == 0
    for make in (lambda: connectors.sql_tables(spark), lambda: Engine.open(spark, str(tmp_path / "c")).add_sql()):
        with pytest.raises(ValueError):
            make()


def test_sites_by_command_line_and_fetcher(spark, tmp_path, capsys, monkeypatch):
    pages = {"https://a.org/": ("Home", '<a href="/b">b</a> welcome'), "https://a.org/b": ("B", "rivers and lakes")}
    e = Engine.open(spark, str(tmp_path / "cat"))
    assert e.add_url("a.org", pages.get, public=lambda _: True).build()["indexed"] == 2
    assert e.search("rivers lakes")[0]["uri"] == "https://a.org/b"
    # No page is fetched from a host that isn't public.
    assert main(["--root", str(tmp_path / "cli"), "index", "http://localhost/x", "--max-pages", "3"], spark) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] == 0
    assert connectors.http_fetch("http://127.0.0.1:9/") is None


def test_pages_become_items(spark):
    pages = spark.createDataFrame([("https://a.org/x", "", "text", 0), ("https://a.org/y", "Y", "", 1), ("", "Z", "t", 1)], "url string, title string, text string, depth int")
    assert [(r["uri"], r["title"], r["media_type"]) for r in connectors.from_pages(pages).collect()] == [("https://a.org/x", "https://a.org/x", "html")]


def test_decoders_of_other_encodings_and_json():
    assert readers.decoded("é".encode()) == "é" and readers.decoded("é".encode("utf-16")) == "é"
    assert readers.decoded(b"\xe9ab") == "éab"
    assert readers.REGISTRY.parse("a.json", b'{"b": [1]}') == [("text", '{\n  "b": [\n    1\n  ]\n}', "a.json")]
    assert readers.REGISTRY.parse("a.jsonl", b'{"a":1}\n{"a":2}') == [("text", '{"a":1}\n{"a":2}', "a.jsonl")]
    assert readers.REGISTRY.parse("a.tsv", b"a\tb\n1\t2\n") == [("table", "a | b\n1 | 2", "a.tsv")]
    assert len(readers.REGISTRY.parse("a.csv", b"x\n" * 5000)[0][1].split("\n")) == readers.TABLE_ROWS + 1


def test_optional_decoders_by_stand_ins(monkeypatch):
    import sys
    import types

    def module(name, **members):
        m = types.ModuleType(name)
        m.__dict__.update(members)
        monkeypatch.setitem(sys.modules, name, m)

    thing = types.SimpleNamespace
    module("pypdf", PdfReader=lambda _: thing(pages=[thing(extract_text=lambda: " one "), thing(extract_text=lambda: None)]))
    module("docx", Document=lambda _: thing(paragraphs=[thing(text="a"), thing(text=" "), thing(text="b")]))
    frame = lambda t: thing(has_text_frame=True, text_frame=thing(text=t))
    module("pptx", Presentation=lambda _: thing(slides=[thing(shapes=[frame(" x "), frame("y")]), thing(shapes=[])]))
    module("openpyxl", load_workbook=lambda *_, **__: thing(worksheets=[thing(title="S", iter_rows=lambda **_: [(1, None, "z"), (None,)])]))
    module("pytesseract", image_to_string=lambda _: " seen ")
    module("PIL", Image=thing(open=lambda _: None))
    parse = readers.REGISTRY.parse
    assert parse("a.pdf", b"") == [("page", "one", "p.1")] and parse("a.docx", b"") == [("text", "a\nb", "a.docx")]
    assert parse("a.pptx", b"") == [("slide", "x\ny", "slide 1")] and parse("a.xlsx", b"") == [("sheet", "1 | z", "S")]
    assert parse("a.png", b"") == [("text", "seen", "a.png")]


def test_registered_reader_is_used(spark, monkeypatch):
    monkeypatch.setattr(readers.REGISTRY, "readers", dict(readers.REGISTRY.readers))
    readers.register_reader((".q",), lambda name, data: [("text", data.decode().upper(), name)])
    assert readers.REGISTRY.parse("x.q", b"abc") == [("text", "ABC", "x.q")] and "q" in readers.supported_extensions()


def test_versions_by_etag(spark):
    from vellum.functions import text as T

    rows = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("a", ""), ("a", None)], "data string, etag string")
    ids = [r[0] for r in rows.select(T.version_id("data", F.col("etag"))).collect()]
    assert ids[0] == ids[1] != ids[2] == ids[3]


def test_langchain_tool(spark, tmp_path, monkeypatch):
    import sys
    import types

    class StructuredTool:
        @classmethod
        def from_function(cls, func, name, description):
            made = cls()
            made.func, made.name, made.description = func, name, description
            return made

    made = types.ModuleType("langchain.tools")
    made.StructuredTool = StructuredTool
    monkeypatch.setitem(sys.modules, "langchain", types.ModuleType("langchain"))
    monkeypatch.setitem(sys.modules, "langchain.tools", made)
    e = Engine.open(spark, str(tmp_path / "cat"))
    e.add_text("Rivers run to the sea.", "r").build()
    tool = e.as_tool().as_langchain_tool()
    assert tool.name == "catalogue_search" and json.loads(tool.func("rivers"))["evidence"]


def test_equal_scores_give_k_by_id(spark):
    """A third of all vectors may be the same; only k of them leave a task."""
    from vellum.operators import search

    records = spark.createDataFrame([(f"r{i:03}", [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(300)], "id string, vector array<float>")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(5)] + [(9, [0.0, 0.0])], "query_id int, vector array<float>")
    for batch in (search.BATCH, 2):
        search.BATCH = batch
        found = search.semantic(records, queries, 4).collect()
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(q, n + 1, i) for q in range(5) for n, i in enumerate(("r001", "r002", "r004", "r005"))]
    search.BATCH = 4096


def test_shared_folder_of_the_context_is_respected(spark, tmp_path, monkeypatch):
    from vellum import session

    class Clustered:
        def __init__(self, real):
            self.real, self.master = real, "spark://host:7077"

        def __getattr__(self, name):
            return getattr(self.real, name)

    class Session:
        def __init__(self, context, settings):
            self.sparkContext, self.settings = context, settings
            self.conf = self

        def get(self, key, default=None):
            return self.settings.get(key, default)

    assert session.shared_folder(Session(Clustered(spark.sparkContext), {"spark.checkpoint.dir": "/shared"})) == "/shared"
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        assert session.shared_folder(Session(Clustered(spark.sparkContext), {})) == folder

    class Bare(Clustered):
        @property
        def _jsc(self):
            none = type("N", (), {"isDefined": lambda s: False, "isEmpty": lambda s: True})()
            return type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: none})()})()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session(Bare(spark.sparkContext), {}))


def test_tables_may_live_elsewhere(spark, tmp_path):
    from vellum.sources.store import SCHEMAS

    class InMemory:
        def __init__(self):
            self.tables = {}

        def read(self, name):
            return spark.createDataFrame(self.tables.get(name, []), SCHEMAS[name])

        def commit(self, tables):
            self.tables |= {n: [tuple(r) for r in df.select(*spark.createDataFrame([], SCHEMAS[n]).columns).collect()] for n, df in tables.items()}

    home = InMemory()
    e = Engine.open(spark, str(tmp_path / "none"), store=home)
    e.add_text("Rivers run to the sea.", "r").build()
    assert e.search("rivers sea")[0]["title"] == "r.txt" and not (tmp_path / "none").exists()
    assert {"documents", "versions", "chunks", "records", "rollups"} <= set(home.tables)
    assert "rivers" in e.records.all_records().where("doc_type = 'file_summary'").first()["terms"]


def test_summary_and_keywords_share_a_worker(spark):
    """Functions of one kind on one row run in one Python worker, and so take its memory once."""
    from vellum.functions import text as T

    rows = spark.createDataFrame([("one. two two. three",), (None,), ("  spaced  ",)], "text string")
    made = rows.select(T.summary_record(F.lit("t"), F.lit("f"), F.lit(""), content.summary("text"), content.keywords("text")).alias("record"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    assert [r["record"] for r in made.collect()] == ["Title: t\nLocation: f\none. two two. three\nKeywords: two, one, three", "Title: t\nLocation: f", "Title: t\nLocation: f\nspaced\nKeywords: spaced"]


def test_slices_are_small():
    """Temporaries of a slice are many times its text, so a batch is cut at about a megabyte."""
    import pyarrow as pa

    from vellum.functions import tokens as K

    texts = pa.array(["x" * 100_000] * 40 + [None])
    parts = K.slices(texts)
    assert sum(len(p) for p in parts) == 41 and max(p.nbytes for p in parts) < 2 << 20
    assert pa.concat_arrays(parts).equals(texts)


def test_postings_shuffle_no_features(spark):
    """A row has all its features; only rows that share an id are counted together."""
    from vellum.operators import vectors

    texts = [(1, "one two two"), (2, "alpha"), (3, None), (4, "--- é"), (None, "lone")]
    plan = vectors.postings(spark.createDataFrame(texts, "id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan

    def weights(rows):
        found = vectors.postings(spark.createDataFrame(rows, "id bigint, text string")).collect()
        return sorted((str(r["id"]), r["bucket"], round(r["weight"], 9)) for r in found)

    def plain(rows):
        out = {}
        for i in {i for i, _ in rows}:
            seen = Counter()
            for j, t in rows:
                tokens = re.findall(r"\b[a-zA-Z0-9][a-zA-Z0-9_\-]*\b", (t or "").lower()) if i == j else []
                seen.update(tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])])
            for token, n in seen.items():
                h = hashlib.md5(token.encode()).digest()
                at = (str(i), int.from_bytes(h[:4], "little") % 512)
                out[at] = out.get(at, 0.0) + (1 - 2 * (h[4] & 1)) * (1 + math.log(n))
        return sorted((*k, round(v, 9)) for k, v in out.items())

    assert weights(texts) == plain(texts)
    again = texts + [(1, "two three"), (None, "lone wolf"), (5, "two two")]
    assert weights(again) == plain(again)


def test_hybrid_embeds_as_it_reads(spark):
    """Records need hold no vectors or terms; neither side shuffles postings, or gives more than a task's best."""
    from vellum.operators import search, vectors
    from vellum.plans import catalogue

    bare = catalogue.records(spark, "/root/testdata/sf0.001")
    asked = catalogue.asked(spark, "/root/testdata/sf0.001")
    assert "vector" not in bare.columns
    full = bare.withColumn("vector", vectors.embedding("text")).withColumn("terms", vectors.distinct_tokens(search.haystack()))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(search.hybrid(bare, asked, 8)) == rows(search.hybrid(full, asked, 8))
    plan = search.lexical(bare, asked, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_lexical_ranking_by_brute_force(spark):
    """Bonus, ties by id, odd queries and passes."""
    from vellum.operators import search

    texts = [None if i % 17 == 0 else " ".join(f"w{i * j % 13}" for j in range(i % 7)) + (" the exact phrase" if i % 11 == 0 else "") for i in range(120)]
    records = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").select("id", F.lit("").alias("title"), F.lit("").alias("uri"), "text", F.array().cast("array<string>").alias("tags"))
    asked = ["w1 w2 w3", "The exact Phrase", "w5 nothing", "", "--", "w1 w1 w12 w4"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    expected = []
    for q, text in enumerate(asked):
        terms = set(re.findall(r"\b[a-z0-9][a-z0-9_\-]*\b", text.lower()))
        score = {i: min(1.0, len(terms & set(t.split())) / len(terms) + 0.25 * (text.lower() in t)) for i, t in enumerate(texts) if t and terms & set(t.split())}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        expected += [(q, i, n + 1, round(score[i], 9)) for n, i in enumerate(best)]
    for batch in (search.BATCH, 2):
        search.BATCH = batch
        found = search.lexical(records, queries, 5).collect()
        assert sorted((r["query_id"], r["id"], r["rank"], r["score"]) for r in found) == sorted(expected)
    search.BATCH = 4096


def test_search_stores_no_vectors(spark):
    """Evidence from records that hold no vectors or terms is the same."""
    from vellum.operators import indexing, search
    from vellum.plans import catalogue
    from vellum.sources import store as stores

    sf = "/root/testdata/sf0.001"
    held = catalogue._indexed(spark, sf)
    assert not {"vector", "terms"} & set(held.columns)
    docs = indexing.analysed(indexing.identified(catalogue.assets(spark, sf))).withColumn("is_current", F.lit(True))
    full = indexing.records_of(docs, spark.createDataFrame([], stores.SCHEMAS["membership"]))
    asked = catalogue.asked(spark, sf).limit(6)
    rows = lambda df: sorted(map(repr, df.collect()))
    for chunks in (None, True):
        assert rows(search.search(held, asked, include_chunks=chunks)) == rows(search.search(full, asked, include_chunks=chunks))


def test_types_of_odd_values(spark, tmp_path):
    """Large doubles are numbers, as in SQL; odd white space around strings goes."""
    from vellum.plans import catalogue

    rows = [(i, f" {i},000.5%　" if i % 2 else f" -${i} ", [0, 1, None][i % 3], 12345678.5 * (i + 1), "\tYes " if i % 2 else "n") for i in range(20)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r["column"]: (r["inferred_type"], r["n_values"]) for r in catalogue._types(spark, str(tmp_path), "customer").collect()}
    assert found == {"c_custkey": ("number", 20), "c_name": ("number", 20), "c_nationkey": ("number", 14), "c_acctbal": ("number", 20), "c_mktsegment": ("boolean", 20)}


def test_string_tests_equal_plain_expressions(spark):
    """Looking for what an expression needs first changes no vote."""
    values = ["", " ", "a@b.co", " a@b.co\n", "x a@b.c", "http://x", "HTTPS://x", "https:/x", "2024-1-2 x", "1/2/34", "1/2/345", "-$1,000.5%", "$5", "5%", "-", "1.", "TRUE", "n", "falsey", "0", "été", " 0 ", None, "x" * 50]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(content.stripped("v").alias("v"))
    got = rows.agg(*content.type_votes("v")).first().asDict()
    kept = [v.strip() for v in values if v and v.strip()]
    assert got == {"n_values": len(kept), "value_chars": sum(map(len, kept))} | {f"is_{n}": sum(bool(re.match(p, v)) for v in kept) for n, p in content.TYPE_TESTS.items()}


def test_vector_search_asks_every_twentieth(spark):
    from vellum.plans import catalogue

    found = catalogue.semantic_topk_batch(spark, "/root/testdata/sf0.001").collect()
    ids = [r["vec_id"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["query_id"] for r in found) == sorted(i for i in ids if i % 20 == 0 for _ in range(10))
