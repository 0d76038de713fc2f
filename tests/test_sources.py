from pyspark.sql import functions as F

from folioscope import sources


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, s string")
    for _ in range(2):
        sources.append_log(df, str(tmp_path / "log"))
    assert sources.json_feed(spark, str(tmp_path / "log"), df.schema).count() == 4
    sources.write_report(df, str(tmp_path / "report"))
    assert sources.json_feed(spark, str(tmp_path / "report"), df.schema).where("id = 1").first()["s"] == "a,b"


def test_csv(spark, tmp_path):
    """By another reader too; nulls and empty strings stay apart, spaces stay."""
    import csv

    rows = [(1, 'a,"b"\nc'), (2, None), (3, ""), (4, " x "), (5, "\\"), (6, 'z"'), (7, "a\rb")]
    df = spark.createDataFrame(rows, "id long, s string")
    sources.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert sorted(map(tuple, sources.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == rows
    (file,) = (tmp_path / "csv").glob("*.csv")
    with file.open(newline="") as f:
        assert {r["id"]: r["s"] for r in csv.DictReader(f)} == {str(k): v or "" for k, v in rows}
    sources.write_csv(df.limit(0), str(tmp_path / "none"))
    assert sources.read_csv(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_binary_texts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"\xff\xff")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in sources.binary_texts(spark, str(tmp_path), lambda b: b.decode()).collect()}
    assert got == {"a.bin": "hello", "b.bin": None}


def test_fields_and_titles(spark):
    row = spark.createDataFrame([('{"a": {"b": "x"}, "c": ""}', "junk\n## S/1\nfirst\ntitle\n## S/2\nsecond")], "raw string, idx string")
    assert row.select(*sources.fields("raw", v=("$.c", "$.a.b"))).first()["v"] == "x"
    assert [tuple(r) for r in row.select(F.explode(sources.index_titles(F.col("idx"), "## ")).alias("x")).select("x.*").collect()] == [("S/1", "first title"), ("S/2", "second")]
    url = row.select(sources.edition_urls("http://h/", F.lit("2024-03-05").cast("date"), F.lit(12), F.lit("va_va")).alias("u")).first()["u"]
    assert url == "http://h/2024/03/05/12_va.pdf"
