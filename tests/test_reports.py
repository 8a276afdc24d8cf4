"""Settings, reports, retention and check-digit zones."""

from pyspark.sql import functions as F

from quaymark.operators import boxes, retention
from quaymark.plans import report
from quaymark.sources import settings


def test_settings():
    s = settings.load(settings.Service, '{"port": "9000", "workers": 99, "host": null}', {"APP_HOST": "h"}, "app")
    assert (s.host, s.port, s.workers) == ("h", 9000, 16)
    assert settings.load(settings.Recognition, "broken") == settings.Recognition()
    assert settings.load(settings.Recognition, '{"accept_non_iso_result": "yes", "layout_oneline_min_ratio": "x"}') == settings.Recognition(accept_non_iso_result=True)


def test_report(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, 7, "a<b>.jpg", 200, None, "A1", "A1", None, {"ocr_ms": 2.0}, 3.0), (2, 7, "c.jpg", 500, "HTTP 500", "", None, None, None, 4.0)],
        "id long, run_id long, file_name string, status_code int, error string, normalized_predicted string, expected_label string, expected_text string, stage_timings map<string,double>, elapsed_ms double",
    )
    path = report.write_once(items, 7, f"file://{tmp_path}")
    body = (tmp_path / "run_7.html").read_text()
    assert "a&lt;b&gt;.jpg" in body and "50.00%" in body and "<li>c.jpg</li>" in body and path.endswith("run_7.html")
    files = spark.createDataFrame([("run_7.html", 7, "2020-01-01"), ("run_8.html", 8, "2020-01-01")], "name string, run_id long, day string").select("name", "run_id", F.to_timestamp("day").alias("mtime"))
    gone = retention.delete_set(files, spark.createDataFrame([(8,)], "id long"), F.lit("2024-01-01").cast("timestamp"), retention.Retention(30, 1))
    assert report.remove(gone, f"file://{tmp_path}") == ["run_7.html"] and (tmp_path / "run_7.html").exists()
    report.remove(gone, f"file://{tmp_path}", dry_run=False)
    assert not (tmp_path / "run_7.html").exists()


def test_check_zones(spark):
    zones = boxes.check_zones(spark.createDataFrame([(1, 100, 40)], "image_id int, width int, height int")).orderBy("zone_ord").collect()
    assert [(z["zone"], z["x2"] - z["x1"] > 0) for z in zones] == [("primary", True), ("mid", True), ("tight", True)]
    squares = spark.createDataFrame([(1, 0, "primary", 1, "9", 0.8, "", 0.0), (1, 0, "primary", 3, "7", 0.9, "7", 0.9)], "image_id int, zone_ord int, zone string, rank int, digit string, score double, inner_digit string, inner_score double")
    reads = spark.createDataFrame([(1, 1, "mid", "4", 0.3)], "image_id int, zone_ord int, zone string, digit string, score double")
    got = boxes.check_votes(squares, reads, ["image_id"]).orderBy("ord").collect()
    assert [(v["digit"], v["source"]) for v in got] == [("9", "square"), ("4", "zone")]
