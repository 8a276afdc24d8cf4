"""Whole plans: recognition on token tables, extracts, staged runs, the stream."""

import pandas as pd
from pyspark.sql import functions as F

from quaymark.operators import routing
from quaymark.plans import recognition
from quaymark.sources import files, inference, schemas
from quaymark.streaming import history


def tokens(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"image_id int{extra}, ord int, text string, score double")


def test_one_line(spark):
    owner = tokens(spark, [(1, 0, "TCKU", 0.95), (2, 0, "?", 0.3)])
    digits = tokens(spark, [(1, 0, "438607", 0.9), (1, 1, "9", 0.8), (2, 0, "12", 0.4)])
    votes = spark.createDataFrame([(1, 0, "9", 0.7, "square", "primary")], "image_id int, ord int, digit string, score double, source string, zone string")
    got = recognition.code_of_regions(owner, digits, votes, ["image_id"]).collect()
    assert sorted((r["image_id"], r["full_code"], r["status"], r["is_valid_iso"]) for r in got) == [(1, "TCKU4386079", "FULL_11", True), (2, "", "RAW_ONLY", False)]
    score = {r["image_id"]: r["score"] for r in got}
    # the owner's 0.95 and its bonuses 0.12 and 0.03; two votes for the digit, of which squares are asked since nothing was read as a whole
    assert score[2] == 0 and score[1] > 0.95 + 0.15


def test_zones_have_no_voice_in_one_line(spark):
    owner, digits = tokens(spark, [(1, 0, "TCKU", 0.95), (2, 0, "TCKU", 0.95)]), tokens(spark, [(1, 0, "123456", 0.9), (2, 0, "123456", 0.9)])
    votes = spark.createDataFrame([(1, 0, "9", 0.7, "zone", "primary"), (2, 0, "9", 0.7, "zone", "primary"), (2, 1, "3", 0.2, "square", "primary")], "image_id int, ord int, digit string, score double, source string, zone string")
    got = recognition.code_of_regions(owner, digits, votes, ["image_id"]).collect()
    assert {r["image_id"]: (r["full_code"], r["status"]) for r in got} == {1: ("TCKU123456", "PARTIAL_10"), 2: ("TCKU1234563", "FULL_11")}


def test_enlarged_zones_are_a_setting(spark):
    owner = tokens(spark, [(1, 0, "TCKU", 0.95)])
    digits = spark.createDataFrame([(1, 0, 0, 0.3, 0.0, 0, "12", 0.9), (1, 1, 0, 0.3, 0.0, 0, "438607", 0.9)], "image_id int, phase int, zone int, zone_x double, bonus double, ord int, text string, score double")
    votes = spark.createDataFrame([], "image_id int, ord int, digit string, score double, source string, zone string")
    found = [recognition.code_of_regions(owner, digits, votes, ["image_id"], resize=on).first()["full_code"][:10] for on in (True, False)]
    assert found == ["TCKU438607", ""]


def test_generic_and_seal(spark):
    rows = tokens(spark, [(1, 0, 0, "TCKU", 0.9), (1, 0, 1, "4386079", 0.8), (1, 1, 0, "XYZ", 0.99), (2, 0, 0, "HELLO", 0.6)], ", variant int")
    got = {r["image_id"]: (r["full_code"], r["status"]) for r in recognition.code_of_any(rows, ["image_id"]).collect()}
    assert got == {1: ("TCKU4386079", "FULL_11"), 2: ("", "RAW_ONLY")}
    seal = spark.createDataFrame([(1, 0, 0, 0, "AB123456", 0.95), (1, 1, 90, 0, "AB999999", 0.99)], "image_id int, stage int, angle int, ord int, text string, score double")
    assert recognition.seal_of(seal, ["image_id"]).first()["text"] == "AB123456"
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    assert {r["image_id"]: (r["text"], r["score"] < 0) for r in recognition.seal_of(seal, ["image_id"], images).collect()} == {1: ("AB123456", False), 2: ("", True), 3: ("", True)}
    assert {r["image_id"]: (r["full_code"], r["status"], r["score"] < 0) for r in recognition.code_of_any(rows, ["image_id"], images=images).collect()} == {1: ("TCKU4386079", "FULL_11", False), 2: ("", "RAW_ONLY", False), 3: ("", "NOT_FOUND", True)}


def test_extracts(spark, tmp_path):
    """Result extracts: a mark at the start, names with blanks and other letters, digits that stay text."""
    from quaymark.functions import codes

    head = "\ufefffile,result,candidate,base10,check_digit,status,raw_text,ocr_ms,total_ms,http_status\n"
    (tmp_path / "lines.csv").write_text(head + "a 1.jpg,TCKU4386079,TCKU4386079,TCKU438607,9,FULL_11,TCKU 438607 9,1.5,2.5,200\n\u043a\u043e\u0434.jpg,NOT_FOUND,,,,RAW_ONLY,12,1.0,134.0375,200\n", encoding="utf-8")
    (tmp_path / "more.csv").write_text(head + "b.jpg,TCLU5533411,TCLU5533411,TCLU553341,1,FULL_11,TCLU 5533411,1.5,2.5,200\nc.jpg,TCKU438600,TCKU438600,TCKU438600,,PARTIAL_10,x,1.5,2.5,200\n", encoding="utf-8")
    rows = files.extracts(spark, f"{tmp_path}/*.csv")
    assert {r["extract"]: r["count"] for r in rows.groupBy("extract").count().collect()} == {"lines": 2, "more": 2}
    assert {r["file"] for r in rows.collect()} == {"a 1.jpg", "\u043a\u043e\u0434.jpg", "b.jpg", "c.jpg"}
    full = rows.where("status = 'FULL_11'")
    assert full.count() == 2 and [r["file"] for r in full.where(codes.is_valid("result")).collect()] == ["a 1.jpg"]
    assert full.where("result <> concat(base10, check_digit)").count() == 0 and rows.where("status = 'RAW_ONLY' and candidate is null").count() == 1


def test_inference_and_staging(spark):
    class Table:
        """A recogniser for tests: the content is the text; one content breaks a batch."""

        def batch(self, images):
            if len(images) > 1 and any(i == b"bad" for i in images):
                raise RuntimeError("batch")
            if images == [b"bad"]:
                raise RuntimeError("image")
            return [[(bytes(i).decode(), 0.5)] for i in images]

    images = spark.createDataFrame([("a", bytearray(b"T1")), ("b", bytearray(b"bad")), ("c", bytearray(b"T1"))], "image_id string, content binary").coalesce(1)
    got = inference.recognise(images, Table).orderBy("image_id").collect()
    assert [(r["image_id"], r["text"]) for r in got] == [("a", "T1"), ("c", "T1")]
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    out = routing.staged(df, [lambda d: d.withColumn("r", F.when(F.col("n") == 1, "first")), lambda d: d.withColumn("r", F.lit("second"))], F.col("r").isNotNull())
    assert sorted(tuple(r) for r in out.collect()) == [(1, "first"), (2, "second"), (3, "second")]


def test_files(spark, tmp_path):
    for name, content in {"x/B.JPG": b"1", "x/a.png": b"22", "x/c.txt": b"TCKU4386079"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert [r["file_name"] for r in files.listing(spark, str(tmp_path)).collect()] == ["B.JPG", "a.png"]
    assert {(r["file_name"], bytes(r["content"])) for r in files.images(spark, str(tmp_path)).collect()} == {("B.JPG", b"1"), ("a.png", b"22")}
    note = files.notes(spark, f"{tmp_path}/x/c.txt").first()
    assert (note["name"], note["content"]) == ("c.txt", "TCKU4386079")
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(50)], "line_no int, value string")
    assert files.log_tails(lines, lines, 5).count() == 40
    assert len(schemas.ITEMS) == 13


def test_stream(spark, tmp_path):
    pd.DataFrame({"created_at": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 02:00"]).astype("datetime64[us]"), "status": ["FULL_11", "FULL_11", "NOT_FOUND"], "content_hash": ["a", "a", "b"]}).to_parquet(tmp_path / "e.parquet")
    batch = spark.read.parquet(str(tmp_path / "e.parquet")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = history.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
    q = history.append(history.first_of_content(stream), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
