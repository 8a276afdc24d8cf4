"""Golden vectors and small cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from quaymark.functions import codes, text

#: Published codes, the digit they should end in and whether they do.
CODES = [
    ("EITU1786393", 3, True), ("IRSU2657681", 1, True), ("TCKU4386079", 9, True), ("TCLU5533411", 7, False), ("PCIU1278634", 4, True), ("HDMU6399989", 6, False), ("FCIU8134937", 7, True), ("STXU2071253", 3, True), ("HASU5022056", 6, True), ("PONU7973963", 3, True),
    ("WHLU2799031", 1, True), ("CBHU4337028", 8, True), ("CMAU4684781", 1, True), ("MSKU2737060", 0, True), ("TGHU9951883", 3, True), ("CARU9995859", 6, False), ("DLTU9021283", 3, True), ("FITU5585844", 4, True), ("DLTU9024528", 8, True), ("HALU2079455", 3, False),
    ("HALU2078945", 5, True), ("HATU2106199", 9, True), ("SKLU1906055", 4, False), ("SKLU1900600", 5, False), ("BCUU6673740", 3, False), ("HNIU3651706", 9, False), ("BSIU2351589", 9, True), ("SEGU1313815", 6, False), ("CAIU8819917", 7, True), ("ETRU0307417", 7, True),
    ("TCNU3366195", 6, False), ("TCNU5392147", 7, True), ("EMIU1241424", 3, False), ("ABCU1000080", 0, True), ("ABCU1000120", 0, True),
]


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_check_digits(spark):
    values = [c for c, _, _ in CODES]
    assert column(spark, values, codes.check_digit(F.substring("v", 1, 10))) == [d for _, d, _ in CODES]
    assert column(spark, values, codes.is_valid("v")) == [v for _, _, v in CODES]
    assert column(spark, [None, "", "TCKU43860", "tcku-438607 9"], codes.is_valid("v")) == [False, False, False, True]


@pytest.mark.parametrize(
    ("raw", "found"),
    [("TCKU 4386079", ["TCKU4386079"]), ("XTCKU4386079", ["XTCU0438607", "TCKU4386079"]), ("TCK04386O79", ["TCKU4386079"]), ("TCKU438607", []), ("MSKU27370600", ["MSKU2737060", "SKUU7370600"]), (None, [])],
)
def test_code_windows(spark, raw, found):
    assert column(spark, [raw], codes.code_windows("v")) == [found]


def test_base_windows(spark):
    assert column(spark, ["438607TCKU", "AB TCKUX 438607 9", "ABC"], codes.base_windows("v")) == [["TCKU438607"], ["CKUU438607", "KUXU386079", "ABTU438607"], []]


@pytest.mark.parametrize(
    ("raw", "found"),
    [("TCKU", [("TCKU", 0.12)]), ("T0KU", [("TOKU", 0.12)]), ("TCKUX", [("CKUU", 0.07), ("TKUU", 0.07), ("TCUU", 0.07), ("TCKU", 0.07)]), ("ATCKU7", [("ATCU", 0.03), ("TCKU", 0.03), ("CKUU", 0.03)]), ("ABC", []), (None, [])],
)
def test_owner_candidates(spark, raw, found):
    assert [tuple(x) for x in column(spark, [raw], codes.owner_candidates("v"))[0]] == found


def test_seal_quality(spark):
    assert column(spark, ["", "AB12", "ABCDE", "12345", "AB1234567890", None], F.round(text.seal_quality("v"), 6)) == [0.0, 0.0, 0.345, 0.695, 1.0, 0.0]


def test_labels_and_json(spark):
    assert column(spark, ["seen tcku4386079 today", "no code", "", None, "xTCKU4386079"], codes.first_code("v")) == ["TCKU4386079", None, None, None, None]
    bodies = ['{"result": " A1 "}', '{"message": "processed: 1, RESULT: B2 "}', "not json", None]
    assert column(spark, bodies, text.result_text("v", F.lit("Result: C3"))) == ["A1", "B2", "C3", "C3"]
    reasons = ['{"failure_reason": "x"}', '{"ocr_debug": {"reason": "ok"}}', '{"ocr_debug": {"reason": "raw_only"}}', "{"]
    assert column(spark, reasons, text.failure_reason("v")) == ["x", "", "raw_only", ""]
    assert column(spark, ['{"timings_ms": {"ocr_ms": "1.23456", "read_ms": null, "bbox_ms": "bad", "other": 3}}', None], text.stage_timings("v")) == [{"ocr_ms": 1.235}, {}]


def test_paths(spark):
    paths = ["a\\images\\X.JPG", "x.tar.gz", ".hidden", "dir/none"]
    assert column(spark, paths, text.stem("v")) == ["X", "x.tar", ".hidden", "none"]
    assert column(spark, paths, text.suffix("v")) == ["jpg", "gz", "", ""]
    assert column(spark, paths, text.parent_name("v")) == ["images", "", "", "dir"]
    assert column(spark, paths, text.mime("v"))[:2] == ["image/jpeg", "application/octet-stream"]


def test_formats(spark):
    assert column(spark, [0.5, None], text.percent("v"), "double") == ["50.00%", "N/A"]
    assert column(spark, [1.23456, None], text.number("v"), "double") == ["1.235", "N/A"]
    assert column(spark, ["TCKU4386079", "TCKU438607", "", None], codes.status("v", F.lit("r"))) == ["FULL_11", "PARTIAL_10", "RAW_ONLY", "RAW_ONLY"]
