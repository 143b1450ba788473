import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators.chunking import ChunkRules, chunks
from fathomline.operators.completion import Client, complete
from fathomline.plans.settings import load_settings
from fathomline.sources import readers, writers


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.txt").write_bytes(b"plain \xff text")
    (d / "b.html").write_text("<p>x</p><script>no</script>")
    (d / "c.json").write_text(json.dumps({"a": ["x", 1, None, True], "b": {"c": "y"}}))
    (d / "d.json").write_text('{"a": "1st"}\nnot json\n{"a": "2nd"}')
    (d / "e.jsonl").write_text('{"t": "one"}\nbad\n\n{"t": "two"}')
    (d / "f.csv").write_text("n,s\n1,ab\n2,\n")
    (d / "g.xyz").write_text("other")
    (d / "h.txt").write_text("   ")
    (d / "i.parquet").write_bytes(b"broken")
    (d / "sub").mkdir()
    (d / "sub" / "j.md").write_text("# T")
    return d


def test_all_formats(spark, files):
    got = {r.path.rsplit("/", 1)[1] + (f":{r.record}" if r.record is not None else ""): (r.type, r.text) for r in readers.load(spark, str(files)).collect()}
    assert got == {
        "a.txt": ("text", "plain � text"), "b.html": ("html", "x"), "c.json": ("json", "x\n1\nTrue\ny"), "d.json": ("json", "1st\n2nd"), "e.jsonl:0": ("jsonl", "one"),
        "e.jsonl:1": ("jsonl", "two"), "f.csv": ("csv", "ab\nnan"), "g.xyz": ("unknown", "other"), "j.md": ("text", "# T"),
    }


def test_paths_in_json():
    data = {"a": [{"b": "x"}, {"b": "y"}], "c": 3}
    assert readers.flatten(data, ("a.1.b", "c", "a.9", "z")) == "y\n3"


def test_sinks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "a, \"b\"\nc " * 30)], "doc_id string, text string")
    c = chunks(docs, ChunkRules(64, 8)).cache()
    writers.write(c, str(tmp_path / "x.jsonl"))
    again = readers.load_chunks(spark, str(tmp_path / "x.jsonl"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, c.collect()))
    writers.write(c, str(tmp_path / "x.csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "x.csv"))
    assert back.columns == writers.CSV_ORDER and back.count() == c.count()
    writers.write(c, str(tmp_path / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == c.count()


def test_conversion_boundary(spark, files):
    pages = readers.convert(spark, str(files / "a.txt"), lambda path, data: [(1, data.decode("latin-1"), "md"), (2, "", "")])
    rows = pages.orderBy("page_no").collect()
    assert [r.page_no for r in rows] == [1, 2] and rows[0].page_hash != rows[1].page_hash


def test_completion_retries(spark):
    async def call(prompt):
        if prompt == "bad":
            raise ValueError("never")
        if prompt == "slow":
            raise OSError("down")
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("slow",), (None,)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in complete(df, Client(call, retries=1, first=0.0)).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: never"), "slow": (None, "OSError: down"), None: (None, None)}


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("chunk_size: 512\nmetric: 'l2 # not a comment'\n")
    monkeypatch.setenv("FATHOMLINE_TOP_K", "7")
    s = load_settings(str(f))
    assert (s.chunk_size, s.top_k, s.metric) == (512, 7, "l2 # not a comment")
    f.write_text("chunk_size: many")
    with pytest.raises(ValueError):
        load_settings(str(f))
    f.write_text("nothing: 1")
    with pytest.raises(ValueError):
        load_settings(str(f))


def test_blank_kept_if_asked(spark, files):
    rows = readers.load(spark, str(files / "h.txt"), drop_blank=False).select(F.length("text").alias("n")).collect()
    assert [r.n for r in rows] == [0]


def test_bad_files_are_named(spark, files):
    rows = readers.failed(spark, str(files)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.type) for r in rows] == [("i.parquet", "parquet")] and rows[0].error
    pages = readers.convert(spark, str(files / "a.txt"), lambda path, data: [(1 // 0, "", "")]).collect()
    assert len(pages) == 1 and pages[0].error.startswith("ZeroDivisionError") and pages[0].page_no is None
    assert readers.ocr_options("easyocr", ("de",))["languages"] == ["de"]
    with pytest.raises(ValueError):
        readers.ocr_options("abacus")


def test_records_of_large_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"t": f"text {i}", "n": [i, None]}) + "\n" for i in range(500)) + "bad\n")
    (tmp_path / "b.csv").write_text("n,s,u\n1,ab,\n2,cd,x\n")
    spark.range(6).select("id", F.concat(F.lit("v"), "id").alias("s")).write.parquet(str(tmp_path / "c.parquet"))
    lines = readers.load_records(spark, str(tmp_path / "a.jsonl"), "jsonl").collect()
    assert sorted(r.text for r in lines) == sorted(f"text {i}\n{i}" for i in range(500)) and len({r.id for r in lines}) == 500
    assert [r.text for r in readers.load_records(spark, str(tmp_path / "a.jsonl"), "jsonl", ("n.0",)).limit(1).collect()] == ["0"]
    assert sorted(r.text for r in readers.load_records(spark, str(tmp_path / "b.csv"), "csv").collect()) == ["1\nab", "2\ncd\nx"]
    got = readers.load_records(spark, str(tmp_path / "c.parquet"), "parquet", ("s",))
    assert sorted(r.text for r in got.collect()) == [f"v{i}" for i in range(6)]
    assert "id" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    with pytest.raises(ValueError):
        readers.load_records(spark, str(tmp_path), "xml")


def test_pages_tables_and_markdown(spark, tmp_path):
    pages = spark.createDataFrame([("p", 2, "b", "## b"), ("p", 1, "a", "# a"), ("q", None, None, None)], "path string, page_no int, text string, markdown string")
    writers.write_pages(pages, str(tmp_path / "pages"))
    assert set(spark.read.parquet(str(tmp_path / "pages")).columns) == {*pages.columns, *writers.PAGE_PARTS}
    writers.write_markdown(pages, str(tmp_path / "md"))
    files = list((tmp_path / "md").rglob("*.txt"))
    assert [f.read_text() for f in files] == ["# a\n\n## b\n"]
    writers.write_tables(spark.createDataFrame([("p", 1, "a,b\n1,2", "<table/>"), ("p", 2, "c", None)], "path string, table_no int, csv string, html string"), str(tmp_path / "t"))
    assert sorted(f.read_text() for f in (tmp_path / "t" / "kind=csv").rglob("*.txt")) == ["a,b\n1,2\n", "c\n"]


def test_files_to_chunks(spark, files, tmp_path):
    from fathomline.sources import chunk_files

    chunk_files.main([str(files), "--out", str(tmp_path / "c.jsonl"), "--size", "8", "--overlap", "2"])
    got = readers.load_chunks(spark, str(tmp_path / "c.jsonl")).collect()
    assert {r.text for r in got if r.doc_id.endswith("c.json")} and max(len(r.text.encode()) for r in got) <= 8


def test_images(spark, tmp_path):
    pages = spark.createDataFrame([("p", 1, b"one"), ("p", 12, b"two"), ("q", 1, None)], "path string, page_no int, image binary")
    for _ in range(2):
        folders = writers.write_images(pages, str(tmp_path / "i"))
    assert len(folders) == 1 and sorted(f.name for f in (tmp_path / "i" / folders[0]).iterdir()) == ["page-00001.png", "page-00012.png"]
    assert (tmp_path / "i" / folders[0] / "page-00012.png").read_bytes() == b"two"
    with pytest.raises(Exception, match="leads out"):
        writers.write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), str(tmp_path / "i"))
