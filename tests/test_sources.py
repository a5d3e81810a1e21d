"""Readers, sinks, streams, plans and the driver's contract."""

import re
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.operators import eventstudy, indicators, vectors
from tidewell.operators import text as text_operators
from tidewell.sources import readers, sinks
from tidewell.sources.views import bars, candles, table
from tidewell.streaming import windows

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bad_times_are_errors(spark):
    rows = spark.createDataFrame([("123,1,1,1,1,1,0,0,0,1,0,0",)], "line string")
    with pytest.raises(Exception, match="neither ms nor us"):
        readers.klines(rows).collect()


def test_unknown_file_kinds_are_errors(spark):
    df = spark.createDataFrame([("a/b.exe",)], "p string")
    with pytest.raises(Exception, match="no parser"):
        df.select(readers.parser_of(F.col("p"))).collect()


def test_files_and_sums(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("매출".encode("cp949"))
    (tmp_path / "b.txt").write_bytes("매출".encode())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.t for r in files.select(readers.decoded(F.col("content")).alias("t")).collect()] == ["매출", "매출"]
    sums = files.select("path", F.sha2("content", 256).alias("sha256")).where("path like '%b.txt'")
    assert sorted((r.path[-5], r.ok) for r in readers.verified(files, sums).collect()) == [("a", False), ("b", True)]
    assert readers.lines(spark, str(tmp_path / "b.txt")).first().line == "매출"


def test_company_codes_from_xml(spark, tmp_path):
    path = tmp_path / "codes.xml"
    path.write_text("<result><list><corp_code>1</corp_code><stock_code>005930</stock_code></list><list><corp_code>2</corp_code><stock_code> </stock_code></list></result>")
    rows = spark.read.format("xml").option("rowTag", "list").schema("corp_code string, stock_code string").load(str(path))
    assert [r.corp_code for r in rows.where(F.trim("stock_code") != "").collect()] == ["1"]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    sinks.overwrite(df, str(tmp_path / "t"))
    sinks.overwrite(df.limit(2), str(tmp_path / "t"))
    sinks.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7
    sinks.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5


def streamed(spark, tmp_path, work, mode="append"):
    """The result of a streaming run over two files of events, read back."""
    e = table(spark, SF, "events").orderBy("ts")
    half = e.agg(F.percentile("event_id", 0.5)).first()[0]
    source = tmp_path / "in"
    e.where(F.col("event_id") < half).coalesce(1).write.mode("append").parquet(str(source))
    e.where(F.col("event_id") >= half).coalesce(1).write.mode("append").parquet(str(source))
    windows.run_once(work(windows.event_stream(spark, str(source), e.schema)), str(tmp_path / "out"), str(tmp_path / "check"), mode)
    return spark.read.parquet(str(tmp_path / "out")), e.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("work", [lambda e: windows.bars(e, late="40 days"), lambda e: windows.over_limit(e, "1 hour", 1, "40 days")])
def test_closed_windows_equal_batch(spark, tmp_path, work):
    """What a stream has closed is what the batch says of it; open windows wait for the watermark."""
    out, events = streamed(spark, tmp_path, work)
    batch = {str(r) for r in work(events).collect()}
    assert {str(r) for r in out.collect()} <= batch


def test_cooldown_stream(spark, tmp_path):
    out, events = streamed(spark, tmp_path, lambda e: windows.cooldown(e, 3600))
    taken = out.orderBy("user_id", "event_type", "ts").collect()
    assert taken
    last = {}
    for r in taken:
        k = (r.user_id, r.event_type)
        assert k not in last or (r.ts - last[k]).total_seconds() >= 3600
        last[k] = r.ts
    assert set(last) == {(r.user_id, r.event_type) for r in events.select("user_id", "event_type").distinct().collect()}


def test_batches_are_handed_over(spark, tmp_path):
    e = table(spark, SF, "events")
    seen = []
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    windows.each_batch(windows.event_stream(spark, str(tmp_path / "in"), e.schema), lambda df, i: seen.append(df.count()), str(tmp_path / "c"))
    assert sum(seen) == e.count()


def test_one_sort_by_symbol(spark):
    """Indicators of one key share an exchange, and stay in the JVM."""
    df = indicators.bollinger(indicators.atr(indicators.rsi(candles(spark, SF))))
    text = plan(df)
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\)", text)) == 1
    assert "Python" not in text and "Arrow" not in text and "InPandas" not in text


def test_scans_are_pruned(spark):
    text = plan(candles(spark, SF).where("symbol = '5-LOW'"))
    assert "o_comment" not in text and "EqualTo(o_orderpriority,5-LOW)" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text.replace("\n", "")


def test_exit_search_has_no_join(spark):
    df = eventstudy.trades(indicators.atr(bars(spark, SF), 14, "atr14"), 12, 0.0, 0.0, single=False)
    assert "Join" not in plan(df)


def test_entry_and_registry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_training_data():
    """The engine works where the subpackage is gone."""
    code = "import sys; sys.modules['tidewell.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 300 and not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_nothing_else_imports_training_data():
    for path in (ROOT / "tidewell").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidewell.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_quoted_fields(spark):
    lines = spark.createDataFrame([('1,"a, ""b""",3.5,Y,"text, more"',), ("2,,x",), ("",)], "line string")
    out = readers.products(lines).collect()
    assert [tuple(r) for r in out] == [("1", 'a, "b"', 3.5, True, "text, more"), ("2", "", None, None, None), ("", None, None, None, None)]
    bars = spark.createDataFrame([('1700000000000,"1,000.5",2,3,4,5,6,7,8,9,10,11',)], "line string")
    assert readers.klines(bars).first().high == 2.0


def test_references_are_decoded_once(spark):
    said = "a &amp;lt; b &#233; &#x1F600; &nbsp;c &#0; &#99999999; &bogus; &#xD800;x"
    out = spark.createDataFrame([(said,), ("",), (None,)], "t string").select(readers.unescaped(F.col("t")).alias("u")).collect()
    assert [r.u for r in out] == ["a &lt; b é \U0001f600  c \ufffd &#99999999; &bogus; \ufffdx", "", None]


def test_cooldown_state_ends(spark, tmp_path):
    """State of keys whose cooldown the watermark has passed is dropped."""
    def day(i):
        return datetime(2024, 1, i, tzinfo=timezone.utc)

    folder, schema = str(tmp_path / "in"), "user_id long, event_type string, ts timestamp, event_id long"
    for i in range(1, 5):
        spark.createDataFrame([(k, "a", day(3 * i), i * 10 + k) for k in range(3 * i, 3 * i + 3)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    done = windows.cooldown(stream, 3600).writeStream.format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert spark.table("cool").count() == 12
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] < 12


def test_office_files(spark, tmp_path):
    import io
    import zipfile

    def made(name, parts):
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for path, xml in parts.items():
                z.writestr(path, xml)
        (tmp_path / name).write_bytes(body.getvalue())

    w, a, s = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"', 'xmlns="urn:s"'
    made("a.docx", {"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>Head</w:t></w:r><w:r><w:t> line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>x</w:t></w:p></w:tc><w:tc><w:p><w:t>1</w:t></w:p></w:tc></w:tr></w:tbl><w:p/></w:d>"})
    made("b.PPTX", {f"ppt/slides/slide{i}.xml": f"<a:s {a}><a:p><a:t>slide {i}</a:t></a:p></a:s>" for i in (10, 2)} | {"ppt/slides/slide3.xml": f"<a:s {a}/>"})
    made("c.xlsx", {"xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<w {s}><row><c t="s"><v>0</v></c><c/><c><v>2.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></w>'})
    made("d.xlsx", {"xl/worksheets/sheet1.xml": "<broken"})
    (tmp_path / "e.docx").write_bytes(b"no archive")
    (tmp_path / "f.md").write_text("text")
    out = readers.office_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    found = sorted((r.path.rsplit("/", 1)[1], r.part, r.text) for r in out if r.error is None)
    assert found == [("a.docx", 1, "Head line\nx | 1"), ("b.PPTX", 2, "slide 2"), ("b.PPTX", 10, "slide 10"), ("c.xlsx", 1, "name | 2.5\nin")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in out if r.error) == ["d.xlsx", "e.docx"]


def test_a_search_keeps_the_best_of_each_partition(spark):
    """The group limit runs before the exchange by query, so that few points of a partition move."""
    points = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).repartition(4)
    text = plan(vectors.search(points, points.where("vec_id % 50 = 0"), 3))
    assert "WindowGroupLimit" in text and text.index("WindowGroupLimit") != text.rindex("WindowGroupLimit")
    assert "Exchange hashpartitioning(query" in text


def test_chunks_split_a_text_once(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.size(text_operators.chunks(F.repeat(F.lit("word "), n), 200, 40)).alias("n"))
        started = time.time()
        assert df.first().n == len(range(0, n - 40, 160))
        return time.time() - started

    seconds(1000)
    assert seconds(640_000) < 20
