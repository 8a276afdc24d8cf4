"""Logs, runs, schemas, snapshots, datasets, crops and clean-up."""

import json

import pytest
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.operators import history, ranking, retention, routing
from quaymark.plans import report
from quaymark.sources import files, inference, schemas, settings


def test_log_lines_over_splits_and_files(spark, tmp_path):
    want = [f"line {k} " + "x" * (k % 37) for k in range(2000)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.log").write_text("\n".join(want[:1500]) + "\n")
    (tmp_path / "log/b.log").write_text("\n".join(want[1500:]))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.log_lines(spark, f"{tmp_path}/log")
        assert lines.rdd.getNumPartitions() > 8
        assert [(r["line_no"], r["value"]) for r in lines.orderBy("line_no").collect()] == list(enumerate(want, 1))
        tail = files.log_tail(lines, 30, "app").collect()
        assert [r["value"] for r in tail] == want[-30:] and tail[-1]["line_no"] == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert files.log_lines(spark, f"{tmp_path}/none").count() == 0
    assert files.log_tails(lines, files.log_lines(spark, f"{tmp_path}/none"), 20).count() == 20


@pytest.mark.parametrize("order", ["n long", "s string"])
def test_numbers_of_ranges(spark, order):
    name, kind = order.split()
    values = [None, *[str(k) if kind == "string" else k for k in range(500)]]
    rows = spark.createDataFrame([(v,) for v in values], order).repartition(4)
    got = ranking.numbered(rows, name, "id", 7, ranges=9).collect()
    assert {r[name]: r["id"] for r in got} == {v: k for k, v in enumerate(sorted(values, key=lambda v: (v is not None, v or "" if kind == "string" else v or 0)), 7)}
    assert ranking.numbered(rows.where("false"), name).count() == 0
    assert [r["id"] for r in ranking.numbered(rows.where(f"{name} is null"), name).collect()] == [1]


ITEMS = "file_name string, status_code int, error string, normalized_predicted string, expected_label string, expected_text string, elapsed_ms double"


def test_runs_are_seen_when_committed(spark, tmp_path):
    path = str(tmp_path / "bench")
    assert [df.count() for df in history.runs_at(spark, path)] == [0, 0]
    items = spark.createDataFrame([("b.jpg", 200, None, "A1", "A1", None, 2.0), ("a.jpg", 500, "HTTP 500", "", None, None, 4.0)], ITEMS)
    assert history.store_run(items, {"created_at": "2024-01-01", "dataset_dir": "d"}, path) == 1
    # a run that stopped before its header: not seen, and its ids are not given again
    rows = schemas.read_table(spark, f"{path}/test_items", schemas.ITEMS)
    rows.withColumn("run_id", F.lit(2).cast("long")).withColumn("id", F.col("id") + 2).write.mode("append").parquet(f"{path}/test_items")
    headers, seen = history.runs_at(spark, path)
    assert [r["id"] for r in headers.collect()] == [1] and {r["run_id"] for r in seen.collect()} == {1}
    assert history.store_run(items, {"mode": "seal"}, path) == 3
    headers, seen = history.runs_at(spark, path)
    assert sorted((r["run_id"], r["id"], r["file_name"]) for r in seen.collect()) == [(1, 1, "a.jpg"), (1, 2, "b.jpg"), (3, 5, "a.jpg"), (3, 6, "b.jpg")]
    got = {r["id"]: r for r in history.parsed_summaries(headers).collect()}
    assert got[1]["summary_ok"] and (got[1]["summary"]["total_images"], got[1]["summary"]["ok_requests"], got[1]["summary"]["latency_mean_ms"], got[1]["summary"]["dataset_dir"], got[1]["summary"]["text_accuracy"]) == (2, 1, 3.0, "d", None)
    assert got[3]["summary"]["mode"] == "seal"
    body = {r["id"]: json.loads(r["summary_json"]) for r in headers.collect()}[1]
    assert list(body) == schemas.SUMMARY.fieldNames() and body["text_accuracy"] is None
    reports = spark.createDataFrame([("run_3.html", 3)], "name string, run_id long")
    listed = history.runs_with_reports(history.parsed_summaries(headers), reports).orderBy("id").collect()
    assert [(r["id"], r["has_report"], r["summary"]["total_images"]) for r in listed] == [(1, False, 2), (3, True, 2)]


def test_broken_summaries(spark):
    rows = spark.createDataFrame([(1, "{"), (2, None), (3, "[1]"), (4, '"x"'), (5, '{"total_images": "x", "mode": 7, "new": 1}')], "id long, summary_json string")
    got = {r["id"]: (r["summary_ok"], r["summary"] and (r["summary"]["total_images"], r["summary"]["mode"])) for r in history.parsed_summaries(rows).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, (None, "7"))}


def test_old_and_new_files_together(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, 1, "old.jpg", "A")], "id long, run_id long, file_name string, predicted_text string").write.parquet(path)
    new = spark.createDataFrame([(2, 2, "new.jpg", None, "raw", {"ocr_ms": 1.0}, "later")], "id long, run_id long, file_name string, number_type string, raw_text string, stage_timings map<string,double>, unknown string")
    new.write.mode("append").parquet(path)
    got = {r["id"]: r for r in schemas.read_table(spark, path, schemas.ITEMS, schemas.ITEM_DEFAULTS).collect()}
    assert list(got[1].asDict()) == schemas.ITEMS.fieldNames()
    assert [(got[k]["number_type"], got[k]["raw_text"], got[k]["stage_timings"], got[k]["predicted_text"]) for k in (1, 2)] == [("unknown", "", None, "A"), ("unknown", "raw", {"ocr_ms": 1.0}, None)]
    with pytest.raises(Exception, match="(?i)cast|convert|type"):
        spark.createDataFrame([("x",)], "id string").write.parquet(str(tmp_path / "bad"))
        schemas.read_table(spark, str(tmp_path / "bad"), schemas.ITEMS).collect()


def test_history_and_snapshot(spark, tmp_path):
    rows = spark.sql("select cast(id as long) as id, timestamp'2024-01-01' as created_at, 'e' as endpoint, 'f' as filename, 'r' as raw_text, 'n' as normalized_text, 'DONE' as status, 1.0D as elapsed_ms, false as debug_enabled, 'x' as extra from range(3)")
    history.append_history(rows, str(tmp_path / "h"))
    history.append_history(rows.withColumn("id", F.col("id") + 3), str(tmp_path / "h"))
    kept = spark.read.parquet(str(tmp_path / "h"))
    assert [r["id"] for r in history.history(kept, "e", 2).collect()] == [5, 4] and "extra" not in kept.columns
    for n in (2, 3):
        history.last_snapshot(rows.limit(n).orderBy("id"), "id", str(tmp_path / "s"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [2]
    meta = spark.range(1).select(history.snapshot_meta(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), history.snapshot_meta(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>")).alias("none")).first()
    assert (meta["m"], meta["none"]) == ({"a": "1", "b": "3"}, {})
    wants = spark.createDataFrame([("X",), ("NOT_FOUND",), (None,)], "r string").select(history.wants_snapshot(F.col("r"), False).alias("w")).collect()
    assert [r["w"] for r in wants] == [True, False, False]


def test_dataset_folders(spark, tmp_path):
    def put(*names):
        for n in names:
            (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / n).write_bytes(b"TCKU4386079")

    put("one/images/b.JPG", "one/images/a.png", "one/images/c.txt", "one/images/deep/d.jpg", "one/z.jpg", "one/labels/a.txt", "two/x.jpg", "two/deep/y.jpg", "empty/notes.txt")
    got = files.dataset(spark, f"{tmp_path}/one")
    assert [r["file_name"] for r in got.images.collect()] == ["a.png", "b.JPG"] and got.labels.count() == 1 and got.texts is None
    assert "content" not in got.images.columns
    assert [r["file_name"] for r in files.dataset(spark, f"{tmp_path}/two").images.collect()] == ["x.jpg"]
    for name in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            files.dataset(spark, f"{tmp_path}/{name}")


def test_contents_are_read_once_and_never_moved(spark, tmp_path):
    class Counting:
        def batch(self, images):
            return [[(bytes(i).decode(), 0.5), ("x", 0.25)] for i in images]

    rows = [(f"i{k:02}", bytearray(f"T{k % 7}".encode())) for k in range(40)] + [("none", None)]
    spark.createDataFrame(rows, "image_id string, content binary").write.parquet(str(tmp_path / "images"))
    images = spark.read.parquet(str(tmp_path / "images"))
    got = inference.recognise(images.where("content is not null"), Counting)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sorted((r["image_id"], r["ord"], r["text"]) for r in got.collect()) == sorted((i, o, t) for i, c in rows if c for o, t in ((0, c.decode()), (1, "x")))
    moved = [line for line in plan.splitlines() if line.startswith("Arguments: hashpartitioning(content") or "hashpartitioning(content" in line]
    assert not moved


def test_crops(spark):
    found = spark.createDataFrame([(1, 0, 0.5, -5, 0, 20, 10), (1, 1, 0.9, 0, 0, 8, 8), (1, 2, 0.7, 200, 0, 300, 10), (1, 3, 0.9, 1, 1, 9, 9)], "image_id int, ord int, conf double, x1 int, y1 int, x2 int, y2 int")
    dims = spark.createDataFrame([(1, 100, 50), (2, 400, 100)], "image_id int, width int, height int")
    assert [(r["crop"], r["conf"], r["x1"]) for r in inference.crops(found, dims, 2).orderBy("crop").collect()] == [(0, 0.9, 0), (1, 0.9, 1)]
    assert inference.crops(found, dims).count() == 3 and inference.whole(dims).count() == 2
    assert [r["conf"] for r in inference.top_crop(found, dims).collect()] == [0.9]
    bands = spark.createDataFrame([(2, -1, True)], "image_id int, crop int, two_bands boolean")
    assert {r["image_id"]: r["image_type"] for r in inference.crop_layouts(inference.crops(found, dims), dims, bands).collect()} == {1: "twolines", 2: "twolines"}
    tried = spark.createDataFrame([(1, 0, "", "x", "RAW_ONLY", 0.9, False), (1, 1, "TCKU438607", "x", "FULL_11", 0.1, True), (1, 2, "MSKU273706", "x", "FULL_11", 0.9, True), (2, 0, "", "x", "RAW_ONLY", 0.9, False), (2, 1, "TCKU438607", "", "PARTIAL_10", 0.1, False)], "image_id int, crop int, base10 string, raw_text string, status string, score double, is_valid_iso boolean")
    assert {r["image_id"]: r["crop"] for r in routing.first_valid_crop(tried, ["image_id"]).collect()} == {1: 1, 2: 1}
    assert {r["image_id"]: r["crop"] for r in routing.first_valid_crop(tried, ["image_id"], stop=False).collect()} == {1: 2, 2: 1}


def test_guards_and_lines(spark):
    rows = spark.createDataFrame([(25, "image/png", 1, True), (0, "text/plain", 1, True), (1, "", 11 << 20, True), (2, None, 5, False), (3, "IMAGE/JPEG", 5, None)], "ord int, content_type string, length long, decoded boolean")
    assert [r["skip_reason"] for r in files.guard(rows).orderBy(F.col("ord")).collect()] == ["unsupported_type", "too_large", "not_decodable", None, "too_many_files"]
    results = spark.createDataFrame([("a", "TCKU4386079", 0.98765, True), ("b", "", -1.0, False)], "file_name string, full_code string, score double, is_valid_iso boolean")
    assert [r["value"] for r in files.result_lines(results).collect()] == ["a\tTCKU4386079\tscore=0.9877\tiso6346=True", "b\tNOT_FOUND\tscore=-1.0000\tiso6346=False"]
    assert files.count_line(results).first()["value"] == "TOTAL\t2\tfound=1"
    bodies = spark.createDataFrame([('{"a": "1"}',), ("{",), (None,)], "b string").select(files.debug_meta("b").alias("m")).collect()
    assert [r["m"] for r in bodies] == [{"a": "1"}, {"available": "false"}, {"available": "false"}]


def test_white_space_of_every_kind(spark):
    bodies = ['{"result": "ABCU1\\n"}', '{"result": "\\t ", "message": "processed: 1, RESULT: \\u00a0Q\\u3000"}', '{"message": "RESULT: a\\nb"}', '{"message": "x\\nresult:\\u2003b "}', '{"failure_reason": "\\u001f"}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(text.result_text("b", F.lit(""))).collect()] == ["ABCU1", "Q", "", "b", ""]
    assert [r[0] for r in df.select(text.failure_reason("b")).collect()] == [""] * 5


def test_clean_up(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"run_{k}.html").write_text("x")
    names = spark.createDataFrame([(f"run_{k}.html", k, f"2020-01-0{k}") for k in (1, 2, 3)], "name string, run_id long, day string").select("name", "run_id", F.to_timestamp("day").alias("mtime"))
    runs, folder, now = spark.createDataFrame([(1,), (2,), (3,)], "id long"), f"file://{tmp_path}", F.lit("2020-02-02").cast("timestamp")
    rule = retention.Retention(30, 1, enabled=False)
    assert report.clean_up(names, runs, folder, now, rule, reason="auto") == {"mode": "policy", "reason": "auto", "dry_run": False, "cleanup_enabled": False, "max_age_days": 30, "keep_last_runs": 1, "total_files": 3, "removed_count": 0, "removed_files": [], "skipped": "auto cleanup disabled"}
    said = report.clean_up(names, runs, folder, now, rule, dry_run=True)
    assert (said["candidate_count"], said["removed_count"], said["removed_files"], said["kept_recent_run_ids"]) == (2, 2, ["run_1.html", "run_2.html"], [3]) and len(list(tmp_path.iterdir())) == 3
    (tmp_path / "run_1.html").unlink()
    said = report.clean_up(names, runs, folder, now, rule)
    assert (said["candidate_count"], said["removed_count"]) == (2, 1)
    assert report.clean_up(names, runs, folder, now, rule, mode="all")["removed_count"] == 1 and not [p for p in tmp_path.iterdir() if p.suffix == ".html"]


def test_cleanup_settings():
    of = retention.Retention.of
    assert of({}, {}) == retention.Retention(30, 100, True)
    assert of({"ADMIN_UI_REPORTS_CLEANUP_MAX_AGE_DAYS": "x", "ADMIN_UI_REPORTS_CLEANUP_ENABLED": "off"}, {"testing": {"reports_cleanup": {"max_age_days": 0, "keep_last_runs": "7", "enabled": True}}}) == retention.Retention(1, 7, False)
    assert of({}, {"testing.reports_cleanup.keep_last_runs": -3, "testing.reports_cleanup.enabled": "no"}) == retention.Retention(30, 0, False)


def test_recognition_settings():
    s = settings.load(settings.Recognition, '{"max_crops_per_image": "3", "use_crop_service": "off", "layout_split_door_min_height": "x"}')
    assert (s.max_crops_per_image, s.use_crop_service, s.layout_split_door_min_height, s.save_debug_on_not_found, s.enable_resize_digit_pass) == (3, False, 420, True, True)


def test_decoding(spark):
    class Sizes:
        def size(self, image):
            if image == b"bad":
                raise ValueError("bad")
            return (len(image), 7) if image != b"no" else None

    rows = spark.createDataFrame([("a", bytearray(b"xyz"), 1), ("b", bytearray(b"bad"), 2), ("c", bytearray(b"no"), 3), ("d", None, 4)], "image_id string, content binary, ord int")
    got = {r["image_id"]: (r["decoded"], r["height"], r["width"], r["ord"]) for r in inference.decoded(rows, Sizes).collect()}
    assert got == {"a": (True, 3, 7, 1), "b": (False, None, None, 2), "c": (False, None, None, 3), "d": (False, None, None, 4)}
