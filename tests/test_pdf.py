"""Portable documents and record streams from bytes made here."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.sources import pdf as P
from quarry.sources import records as R
from quarry.sources import segments as S

FILE = b"""%%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Names [(a\\(b\\)\\101) <48 69> /A#20B -1.5 true null] >> endobj
2 0 obj << /Kids [3 0 R 9 0 R] /Count 2 >> endobj
3 0 obj << /Length 5 >> stream
abcde
endstream endobj
4 0 obj << /Length %d /Filter /FlateDecode >> stream
%s
endstream endobj
5 0 obj << /Broken [ >> endobj
6 0 obj 42 endobj
"""


def test_objects_references_and_faults(spark):
    body = zlib.compress(b"plain text")
    data = FILE % (len(body), body)
    rows = P.read_objects(spark.createDataFrame([("f", data), ("g", b""), ("h", None)], "source string, content binary")).cache()
    got = {r["number"]: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    names = json.loads(got[1]["value"])["dict"]["Names"]
    assert names == [{"hex": b"a(b)A".hex()}, {"hex": b"Hi".hex()}, {"name": "A B"}, {"real": -1.5}, True, None]
    assert got[3]["stream_sha256"] == hashlib.sha256(b"abcde").hexdigest() and got[4]["plain_sha256"] == hashlib.sha256(b"plain text").hexdigest()
    assert got[5]["fault"] and got[6]["value"] == "42"
    assert [(r["owner"], r["number"], r["path"]) for r in P.dangling(rows).collect()] == [(2, 9, "$.Kids[1]")]


def test_values_refuse_depth_and_mismatch():
    with pytest.raises(P.Malformed):
        P.value(b"[" * 200 + b"]" * 200)
    for bad in (b"<< /A >>", b"[ 1", b"R", b"(open"):
        with pytest.raises(P.Malformed):
            P.value(bad)


def test_draws_and_text(spark):
    content = b"q 2 0 0 3 10 20 cm q 1 0 0 1 5 5 cm /Im1 Do Q /Im2 Do Q /Im3 Do"
    draws = P.draws_of(content)
    assert [(d["name"], d["matrix"]) for d in draws] == [("Im1", [2, 0, 0, 3, 20, 35]), ("Im2", [2, 0, 0, 3, 10, 20]), ("Im3", [1, 0, 0, 1, 0, 0])]
    got = spark.createDataFrame([(content,), (b"Q",), (None,)], "c binary").select(P.image_draws("c").alias("d")).collect()
    assert len(got[0]["d"]) == 3 and got[1]["d"] is None and got[2]["d"] is None
    text = "/Artifact BMC 1 0 0 1 0 0 Tm <0041> Tj EMC Tm <4E2D> Tj /Span <</ActualText <FEFF0042>>> BDC x EMC"
    assert spark.createDataFrame([(text,)], "t string").select(P.shown_text(F.col("t")).alias("s")).first()["s"] == ["中", "B"]


def test_widths_and_tiling(spark):
    fonts = spark.createDataFrame([(1, "[1, [500, 600], 7, 9, 250]"), (2, None)], "k int, w string")
    assert sorted((r["k"], r["code"], r["width"]) for r in P.width_rows(fonts, ["k"], "w").collect()) == [(1, 1, 500), (1, 2, 600), (1, 7, 250), (1, 8, 250), (1, 9, 250)]
    rows = [(1, 0, 0xD7FF, 0), (1, 0xE000, 65535, 0xE000), (2, 0, 9, 0), (2, 11, 65535, 11), (3, 0, 65535, 1)]
    assert {r["k"]: r["identity"] for r in P.identity_tiling(spark.createDataFrame(rows, "k int, first int, last int, target int"), ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_record_streams():
    pack = lambda *r: b"".join(struct.pack("<HH", *x) for x in r)
    whole = R.read_stream(pack((0x8001, 7), (0x8002, 9), (3, 65), (0x8001, 8), (4, 66), (0x8004, 0), (5, 5)))
    assert whole["status"] == "TERMINATOR" and [(g["x"], g["y"], g["style"], g["code"]) for g in whole["glyphs"]] == [(3, 7, 9, 65), (4, 8, 9, 66)]
    assert R.read_stream(pack((3, 65)))["status"] == "UNSUPPORTED" and R.read_stream(pack((0x801D, 1)))["status"] == "UNSUPPORTED"
    assert R.read_stream(pack((0x801D, 0)))["status"] == "MALFORMED" and R.read_stream(b"")["status"] == "MALFORMED"
    assert R.read_stream(pack((0x8001, 1), (0x8002, 1), (1, 1), (1, 1)), most=3)["status"] == "LIMIT"


def test_segment_headers(spark):
    text = struct.pack(">IIIIBHI", 640, 480, 0, 0, 0, 0x8002, 77) + b"xx"
    dictionary = struct.pack(">HbbII", 0x1802, 3, -1, 10, 4) + b"body"
    got = spark.createDataFrame([(text, dictionary), (b"", b"")], "t binary, d binary").select(S.text_header(F.col("t")).alias("t"), S.dictionary_header(F.col("d")).alias("d")).collect()
    assert (got[0]["t"]["width"], got[0]["t"]["instances"], got[0]["t"]["anomalous"], got[0]["t"]["refinement"]) == (640, 77, True, 1)
    assert (got[0]["d"]["at"], got[0]["d"]["template"], got[0]["d"]["refinement_template"], got[0]["d"]["body_length"]) == ([3, -1], 2, 1, 4)
    assert got[1]["t"] is None and got[1]["d"] is None


def test_a_token_is_one_match_with_its_kind_and_place():
    content = b" q\t-.5 7. %c\n<</N#41 [<4a 4>(a(b)\\051)]>> Tj \n"
    m = P._TOKEN.match(b" \n12 ")  # white space costs no match of its own
    assert m.lastgroup == "number" and m["number"] == b"12"
    assert list(P.tokens(content)) == [
        ("word", "q", 2), ("number", -0.5, 6), ("number", 7.0, 9), ("mark", "<<", 15), ("name", "NA", 20), ("mark", "[", 22), ("string", b"J@", 28), ("string", b"a(b))", 38), ("mark", "]", 39), ("mark", ">>", 41), ("word", "Tj", 44)
    ]
