from pyspark.sql import functions as F

from folioscope.sources import feed

DDL = "page_id long, url string, html string"


def load(spark, folder, stream=False, **more):
    reader = (spark.readStream if stream else spark.read).format("paged_feed").option("ddl", DDL).option("key", "page_id")
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pages_land_and_come_back(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(7, "again", None), (7, None, "é\n\"quoted\"  "), (None, "no key", "x"), (10**12, "", "")], DDL)
    every = pages.unionByName(extra)
    folder = str(tmp_path / "feed")
    feed.register(spark)
    assert load(spark, folder).collect() == []
    feed.land(every, folder, "page_id", 40)
    feed.land(every, folder, "page_id", 40)  # the same pages again
    got = load(spark, folder)
    assert rows_of(got) == rows_of(every.where("page_id is not null"))
    assert got.rdd.getNumPartitions() == len(feed._pages(folder)) >= 7
    assert rows_of(load(spark, folder, after="100")) == rows_of(every.where("page_id > 100"))


def test_a_stream_goes_on_in_the_middle(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    folder, out, check = (str(tmp_path / x) for x in ("feed", "out", "check"))
    feed.register(spark)

    def run():
        query = load(spark, folder, True).select("page_id", F.length("html").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    want = lambda where: sorted(map(tuple, pages.where(where).select("page_id", F.length("html")).collect()))
    feed.land(pages.where("page_id < 90"), folder, "page_id", 25)
    assert run() == want("page_id < 90")
    assert run() == want("page_id < 90")
    feed.land(pages.where("page_id >= 90 and page_id < 200"), folder, "page_id", 25)
    feed.land(pages.where("page_id >= 200"), folder, "page_id", 25)
    assert run() == want("true")
