"""The paged source and the chunked writer, with pages and tasks that fail in the middle."""

import json

import pytest
from pyspark.errors import PySparkException

from soukspark.sources import chunked, paged


def read(spark, fetch, keys, **options):
    spark.dataSource.register(paged.PagedListing)
    return spark.read.format("paged_listing").options(fetch=f"tests.pages:{fetch}", keys=json.dumps(keys), **options).load()


def test_pages_stop_at_the_first_empty_or_failed_one_and_repeat_no_item(spark):
    rows = read(spark, "fetch", ["a", "b", "c", "d"], size=4).collect()
    got = {}
    for r in rows:
        got.setdefault(r.key, []).append(r.itemid)
    # the third page of a starts with the last item of its second
    assert got == {"a": [0, 1, 2, 3, 4, 5, 6, 7, 9], "b": [0, 1, 2, 3], "d": [0]}
    one = rows[0]
    assert (one.price, one.price_max, one.rating, one.reviews, one.sold, one.stock, one.image) == (2.5, 2.5, 4.5, 7, 3, 0, None)
    assert len(read(spark, "fetch", ["a"], size=4, pages=1).collect()) == 4


def test_ratings_feed_review_images_and_say_why_there_are_none(spark):
    got = {r.key: r for r in paged.reviews(read(spark, "ratings", ["full", "few", "none", "blocked", "late"], kind="ratings", size=20)).collect()}
    assert {k: r.review_status for k, r in got.items()} == {"full": "ok", "few": "ok", "none": "empty", "blocked": "blocked", "late": "ok"}
    assert len(got["full"].review_images) == 60 and got["few"].review_images[:4] == ["few0-0", "v0-0", "few0-1", "v0-1"]
    assert got["none"].review_images == []
    # sixty images are on the second page: the third is not read
    assert read(spark, "ratings", ["full"], kind="ratings", size=20).where("page is not null").agg({"page": "max"}).first()[0] == 1


def test_a_stream_of_pages_goes_on_where_it_failed(spark, tmp_path):
    spark.dataSource.register(paged.PagedListing)

    def run():
        rows = spark.readStream.format("paged_listing").options(fetch="tests.pages:flaky", keys=json.dumps(["x", "y"]), size=4, folder=str(tmp_path)).load()
        q = paged.distinct_items(rows).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(PySparkException):
        run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    (tmp_path / "well").touch()
    run()
    got = sorted((r.key, r.itemid) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(k, i) for k in "xy" for i in (0, 1, 2, 3, 4, 5, 6, 7, 9)]


def test_a_load_that_failed_half_way_is_run_again(spark, tmp_path):
    rows = spark.range(1, 1001).selectExpr("id", "concat('u', id % 900) listing_url", "'a' account").repartition(3)
    options = {"send": "tests.pages:insert", "done": "tests.pages:report", "chunk": "100", "folder": str(tmp_path)}
    with pytest.raises(PySparkException):
        chunked.load(rows, **options)
    before = len(list(tmp_path.glob("row-*")))
    assert 0 < before < 900 and json.loads((tmp_path / "report").read_text())["aborted"]
    (tmp_path / "well").touch()
    chunked.load(rows, **options)
    assert len(list(tmp_path.glob("row-*"))) == 900
    told = json.loads((tmp_path / "report").read_text())
    assert told["rows"] == 1000 and told["new"] == 900 - before and not told["aborted"] and 10 <= told["chunks"] <= 12
    assert max(map(int, (tmp_path / "calls").read_text().split())) == 100


def test_a_log_that_fails_is_passed_over(spark, tmp_path):
    rows = spark.range(1, 1001).selectExpr("id", "concat('u', id) listing_url", "'a' account").repartition(2)
    chunked.load(rows, "tests.pages:insert", done="tests.pages:report", chunk="100", errors="log", folder=str(tmp_path))
    told = json.loads((tmp_path / "report").read_text())
    assert told["failed"] > 0 and told["failed"] + told["rows"] == 1000 and not told["aborted"]
