"""Operators on small inputs with results worked out by hand."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunk, index, ingest, knn, learner, rank, usage
from tessera.plans import search as S
from tessera.sources import notes, parsers, store
from tessera.streaming import usage as stream
from tessera.streaming import watch


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x if values else spark.range(1).select(expr.alias("x")).first().x


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat sat mat"), (2, "cat cat dog"), (3, "bird 한국어 새"), (4, "")], "id int, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, "한국어 cat cat"), (3, "")], "query_id int, query string")
    found = {(r.query_id, r.key): r.score for r in index.bm25_top(docs, queries, "id", "text").collect()}
    n, avgdl = 4, 9 / 4

    def part(df, tf, dl):
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))

    assert found[1, 1] == pytest.approx(part(2, 1, 3)) and found[1, 2] == pytest.approx(part(2, 2, 3))
    assert found[2, 3] == pytest.approx(part(1, 1, 3)) and found[2, 1] == pytest.approx(2 * part(2, 1, 3))
    assert len(found) == 5 and index.bm25_top(docs.limit(0), queries, "id", "text").collect() == []


def test_fusion_and_confidence(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1)], "query_id int, list int, id string, rank int")
    found = {r.id: r.rrf for r in rank.reciprocal_rank_fusion(lists).collect()}
    assert found["b"] == pytest.approx(1 / 62 + 1 / 61) and found["a"] == pytest.approx(1 / 61)
    cases = [((0.8, 3, 3, 3), 0.8), ((0.8, 0, 2, 2), 0.2), ((1.0, 2, 4, 4), 0.5), ((1.0, 3, 3, 4), 0.875), ((0.6, 0, 0, 0), 0.6), ((7.0, 1, 1, 1), 1.0)]
    for (raw, shared, left, right), expected in cases:
        assert one(spark, rank.confidence(*(F.lit(x) for x in (raw, shared, left, right)))) == pytest.approx(expected)
    assert [one(spark, rank.verdict(F.lit(x))) for x in (0.76, 0.75, 0.46, 0.45)] == ["PASS", "FORGE", "FORGE", "INHIBIT"]
    assert [rank.pool_size(5, a) for a in (0.2, 0.5, 0.8)] == [13, 10, 7]


def test_snippets(spark):
    text = "alpha " * 40 + "the needle here " + "omega " * 60
    found = one(spark, T.snippet(F.col("c"), F.col("q")), c=text, q="needle here")
    assert "needle here" in found and len(found) <= 300
    assert "needle" in one(spark, T.snippet(F.col("c"), F.col("q")), c=text, q="xx needle yyyy")
    for q in ("to be", "absent words", ""):
        assert one(spark, T.snippet(F.col("c"), F.col("q")), c=text, q=q) == ""
    assert one(spark, T.shorten(F.col("c"), 12), c="one two three four") == "one two..."


def test_windows(spark):
    for n, expected in ((0, 0), (1, 1), (121, 1), (122, 1), (800, 1), (801, 2), (1480, 2), (1481, 3)):
        rows = chunk.windows(spark.createDataFrame([(1, "x" * n)], "id int, t string"), "id", "t").collect()
        assert len(rows) == expected, n
        assert not rows or (rows[-1].end == n and rows[0].start == 0)


def test_markdown_chunks():
    found = chunk.sections("lead\n# A\na\n### B\nb\n### C\nc\n## D\nd")
    assert [h for h, _ in found] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    long = "# T\n" + "\n\n".join(" ".join(f"w{i}x{j}." for j in range(40)) for i in range(12))
    chunks = chunk.chunk_markdown(long, 120, 20)
    assert all(h == ["T"] for h, _ in chunks) and all(len(c.split()) <= 120 for _, c in chunks) and len(chunks) > 3
    assert chunk.chunk_markdown("") == [] and chunk.split_sentences("A b. C d! E") == ["A b.", "C d!", "E"]
    merged = chunk.chunk_markdown("# A\n" + "word " * 100 + "\n# B\nshort", 512, 64)
    assert len(merged) == 1 and merged[0][0] == ["A"] and merged[0][1].endswith("short")


def test_notes(spark):
    md = '---\ntitle: "My Note"\ndraft: True\ntags: a, b\naliases:\n  - One\n  - Two\n---\n# Head\nText [[x|label]] ![[skip]] [[a/b#s]] #c/d e#f\n'
    n = notes.parse_note(md)
    assert n["frontmatter"]["title"] == ["My Note"] and n["frontmatter"]["draft"] == ["true"]
    assert (n["tags"], n["aliases"], n["links"], n["headings"]) == (["a", "b", "c/d"], ["One", "Two"], ["x", "a/b"], ["Head"])
    assert one(spark, T.wikilinks(F.col("c")), c=md) == ["x", "a/b"] and one(spark, T.inline_tags(F.col("c")), c=md) == ["c/d"]
    dense = spark.createDataFrame([(1, "# One\n" + "dense words here " * 60)], "id int, t string")
    rows = notes.note_chunks(dense, "id", "t", 512, 64, 220, 40).collect()
    assert len(rows) >= 2 and all(len(r.text) <= 220 and r.indexed.startswith("Headings: One") for r in rows)


def test_parsers():
    assert parsers.html_text("<head><title>x</title></head><p>a&amp;b</p><script>no</script><div>c</div>") == "a&b\n\nc"
    assert parsers.vtt_text("WEBVTT\n\nNOTE x\ny\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\n<v Bob>Hi <b>you</b>\n\n00:00:03.000 --> 00:00:04.000\nBye") == "Hi you\nBye"
    tex = parsers.latex_text("\\section{One} % gone\n\\begin{equation}x\\end{equation}A \\emph{b} \\textbf{c}\\cite{z}")
    assert "One" in tex and "A b c" in tex and "gone" not in tex and "x" not in tex
    assert parsers.csv_text("a; b\n;\n1;2") == "a\tb\n1\t2"
    assert parsers.extract("a.unknown", b"plain \xff text") == "plain  text" and parsers.extract("broken.docx", b"no zip") == ""
    assert parsers.rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9}") == "Hello bold\ncafé"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert parsers.extract("x.DOCX", _zip({"word/document.xml": body})) == "Hello\nc1\tc2"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    assert parsers.extract("x.pptx", _zip({"ppt/slides/slide1.xml": f"<s {a}><a:p><a:r><a:t>Slide text</a:t></a:r></a:p></s>"})) == "[Slide 1]\nSlide text"
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = {
        "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>',
    }
    assert parsers.extract("x.xlsx", _zip(sheet)) == "[Sheet: S]\nname\t5"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, s in files.items():
            z.writestr(n, s)
    return out.getvalue()


def test_vectors(spark):
    v = [0.5, -1.0, 2.0, 0.0]
    q = one(spark, V.quantise(F.col("v")), v=v)
    assert max(abs(q.low + q.step * c - x) for c, x in zip(q.codes, v)) <= q.step + 1e-9
    assert one(spark, V.quantise(F.col("v")), v=[1.0, 1.0]).codes == [0, 0]
    assert one(spark, V.cosine(F.col("v"), F.col("v")), v=[0.0, 0.0]) == 0
    rows = {r.id: r.embedding for r in V.hashed(spark.createDataFrame([(1, "Python programming"), (2, "python programming!"), (3, "cooking pasta")], "id int, t string"), "id", "t").collect()}
    assert all(sum(x * x for x in e) == pytest.approx(1) for e in rows.values())
    assert rows[1] == pytest.approx(rows[2]) and sum(a * b for a, b in zip(rows[1], rows[3])) < 0.5


def test_knn_ties_and_lsh(spark, sf_dir):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(9)], "key long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.key for r in knn.knn(vectors, q, 3).orderBy("rank").collect()] == [4, 3, 2]
    assert knn.knn(vectors, q.limit(0), 3).collect() == []
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
    probe = e.where("key < 10").withColumnRenamed("key", "query_id")
    exact = {(r.query_id, r.key) for r in knn.knn(e, probe, 5).collect()}
    near = {(r.query_id, r.key) for r in knn.lsh_knn(e, probe, 5).collect()}
    assert len(exact & near) >= 0.6 * len(exact)


def _corpus(spark, rows):
    schema = "seq long, store string, uri string, title string, content string, headings array<string>, aliases array<string>, tags array<string>, links array<string>, path string, parent string, context string"
    return S.Corpus(spark.createDataFrame([(i, "s", f"local://s/{t}", t, c, [], [], [], [], p, None, None) for i, (t, c, p) in enumerate(rows)], schema))


def test_search_modes(spark):
    c = _corpus(spark, [
        ("Memory Audit.md", "All about memory and audits of systems.", "/v/Memory Audit.md"),
        ("Memory Audit Extended Report.md", "More about the audit of memory.", "/v/Memory Audit Extended Report.md"),
        ("Cooking.md", "Pasta with tomatoes and basil.", "/v/Cooking.md"),
        ("Paper.md", "Pasta with tomatoes and basil and pasta.", "/v/external/Paper.md"),
    ]).embedded()
    q = spark.createDataFrame([(1, "memory audit"), (2, "pasta"), (3, "qqqq zzzz")], "query_id int, query string")
    found = {m: S.search(q, c, m).collect() for m in S.MODES}
    semantic = [r for r in found["semantic"] if r.query_id == 1]
    assert semantic[0].method == "exact" and semantic[0].title == "Memory Audit.md" and semantic[0].confidence >= 0.84
    keyword = [r for r in found["keyword"] if r.query_id == 2]
    assert [r.title for r in keyword] == ["Cooking.md", "Paper.md"] and {r.confidence for r in keyword} == {0.7}
    assert {r.method for r in found["keyword"] if r.query_id == 3} == {"none"}
    assert all({r.query_id for r in rows} == {1, 2, 3} for rows in found.values())
    ranked = [r.uri for r in S.keyword_ranking(q.where("query_id = 2"), c, 10).orderBy("rank").collect()]
    assert ranked[0].endswith("Cooking.md")
    with pytest.raises(ValueError):
        S.search(q, c, "other")
    batch = S.batch(spark.createDataFrame([(1, "pasta", 1), (2, "", 5), (3, "memory", 9)], "query_id int, query string, priority int"), c, "keyword").collect()
    assert [(r.query_id, r.status) for r in batch] == [(3, "success"), (2, "error"), (1, "success")]


def test_ingest(spark):
    cols = "seq long, store string, uri string, path string, fingerprint string, aliases array<string>"
    old = spark.createDataFrame([(1, "s", "u1", "/a", "f", ["x"]), (2, "s", "u2", "/b", "f", ["x", "y"])], cols)
    new = spark.createDataFrame([(3, "s", "u3", "/c", "f", ["y"]), (4, "s", "u4", "/d", "g", ["x"]), (5, "s", "u5", "/a", "f", ["x"])], cols)
    assert [tuple(r) for r in ingest.duplicates_of_existing(new, old).collect()] == [("u3", "u2")]
    rows = spark.createDataFrame([("a", 1, "old")], "k string, v int, x string")
    up = ingest.upsert(rows, spark.createDataFrame([("a", 1, "new"), ("b", 1, "b")], "k string, v int, x string"), ["k"], "v")
    assert {tuple(r) for r in up.collect()} == {("a", 1, "new"), ("b", 1, "b")}
    assert one(spark, T.fingerprint(F.col("c")), c=" a\r\nb \n") == one(spark, T.fingerprint(F.col("c")), c="a\nb")
    assert one(spark, T.alias_keys(F.array(F.lit("My_Note-1.md"), F.lit("my note 1 md")))) == ["my note 1 md", "mynote1md"]
    assert one(spark, T.document_uri(F.lit("s"), F.lit("/a b/é~*.md"))) == "local://s/%2Fa%20b%2F%C3%A9~%2A.md"


def _records(spark, rows):
    return spark.createDataFrame(rows, "api_key string, endpoint string, request_tokens long, response_tokens long, request_bytes long, response_bytes long, duration_ms double, status int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_usage(spark):
    rows = [("k", "/s", 100, 200, 512, 1024, 5.0, 200 if i < 8 else 500, f"2024-01-01 10:{i:02d}:00") for i in range(10)]
    r = _records(spark, rows)
    s = usage.stats(r).first()
    assert (s.requests, s.tokens, s.bytes, s.success_rate) == (10, 3000, 15360, 80.0)
    assert usage.stats(r.where("status = 500")).first().success_rate == 0.0 and usage.stats(r.limit(0)).first().success_rate == 100.0
    quotas = spark.createDataFrame([("k", 10, 100000, 1000, 1000000, 50.0)], "api_key string, daily_requests long, daily_tokens long, monthly_requests long, monthly_tokens long, alert_pct double")
    q = usage.quota_status(r, quotas, "2024-01-01 23:00:00").first()
    assert q.exceeded and q.daily_requests_pct == 100.0 and q.daily_tokens_pct == 3.0
    alerts = usage.cool_down(usage.alert_candidates(r, quotas))
    assert [(x.kind, x.used) for x in alerts.collect()] == [("daily_requests", 5)]
    late = usage.cool_down(usage.alert_candidates(_records(spark, rows + [("k", "/s", 1, 1, 1, 1, 1.0, 200, "2024-01-01 11:04:00")]), quotas))
    assert late.count() == 2


def test_learner(spark):
    schema = "store string, seq int, mode string, confidence double"
    few = spark.createDataFrame([("s", i, "keyword", 0.9) for i in range(9)], schema)
    many = spark.createDataFrame([("s", i, "semantic" if i % 2 else "keyword", 0.9 if i % 2 else 0.3) for i in range(40)], schema)
    assert learner.recommended_alpha(few).first().alpha == 0.5 and learner.recommended_alpha(many).first().alpha == 0.53
    rising = spark.createDataFrame([("s", i, "hybrid", 0.2 if i < 10 else 0.8) for i in range(20)], schema)
    assert learner.summary(rising).first().trend == "improving" and learner.summary(few).first().trend == "insufficient_data"
    assert learner.alpha_path(many, 10).first().alpha > 0.55


def test_store_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_store(spark.createDataFrame([("a", "u1", 1), ("b", "u2", 1)], "store string, uri string, v int"), path)
    after = store.upsert_store(spark.createDataFrame([("a", "u1", 2), ("a", "u3", 1)], "store string, uri string, v int"), path, ["store", "uri"], "v")
    assert {(r.store, r.uri, r.v) for r in after.collect()} == {("a", "u1", 2), ("a", "u3", 1), ("b", "u2", 1)}
    assert [r.store for r in store.stores(after).collect()] == ["a", "b"]
    docs = spark.createDataFrame([(1, "t", "u", "c")], "seq int, title string, uri string, content string")
    text = store.export_snapshot(docs, docs.limit(0), "s", "now").first().value
    for name, body in (("good", text), ("other", json.dumps({"schema_version": 9, "docs": []})), ("bad", "{")):
        (tmp_path / f"{name}.json").write_text(body)
    assert [tuple(r) for r in store.read_snapshot(spark, str(tmp_path / "good.json")).collect()] == [("s", "t", "u", "c")]
    assert store.read_snapshot(spark, str(tmp_path / "other.json")).collect() == [] and store.read_snapshot(spark, str(tmp_path / "bad.json")).collect() == []
    assert store.load_synonyms(str(tmp_path / "absent.json")) == {} and store.load_synonyms(str(tmp_path / "bad.json")) == {}


def test_files_and_watch(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.md").write_text("# A\ntext")
    (files / "b.html").write_text("<p>hello</p>")
    rows = {r.title: r for r in store.ingest_files(spark, str(files), "s").collect()}
    assert rows["b.html"].content == "hello" and rows["a.md"].status == "success" and rows["a.md"].uri.startswith("local://s/%2F")
    before = store.listing(store.read_files(spark, str(files))).collect()
    saved = spark.createDataFrame(before, "path string, size long, digest string")
    (files / "a.md").write_text("# B\ntext!")
    (files / "c.txt").write_text("new")
    (files / "b.html").unlink()
    assert {r.path.rpartition("/")[2]: r.change for r in watch.changes(spark, str(files), saved).collect()} == {"a.md": "changed", "c.txt": "added", "b.html": "deleted"}
    streamed = stream.drained(spark, watch.new_files(spark, str(files)), watch.keyed, "append")
    assert streamed.count() == 2


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
