"""Record layouts, rasters, experiments and proofs on cases that the tables do not have."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import rasters
from quarry.operators import experiments as X
from quarry.operators import proofs as P
from quarry.sources import glyph_model as M
from quarry.sources import layouts as L


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(*values):
    return struct.pack(f"<{len(values)}H", *values)


IMAGE = words(L.IMAGE, 0, 3, 4, 5, 6, *[0] * 8)
FLAGGED = words(L.IMAGE, L.FLAGGED, 0xC003, 4, 0xC005, 6, *[0] * 8)
END = words(L.END, 0)


@pytest.mark.parametrize(
    "data,images,status,framing,boxes",
    [
        (IMAGE + END, 1, "OK", "raw", [(3, 4, 5, 6)]),
        (FLAGGED + END, 1, "OK", "raw", [(3, 4, 5, 6)]),
        (END, 0, "NO_IMAGE", "raw", []),
        (IMAGE, 1, "TRUNCATED", "raw", []),
        (IMAGE[:20], 1, "TRUNCATED", "raw", []),
        (b"", 0, "TRUNCATED", "raw", []),
        (words(0x9999, 0) + IMAGE + END, 1, "UNKNOWN_RECORD", "raw", []),
        (words(0x80CE, 1) + IMAGE + END, 1, "UNKNOWN_RECORD", "raw", []),
        (words(L.IMAGE, 0, 1, 1, 0, 1, *[0] * 8) + END, 1, "EMPTY_IMAGE", "raw", []),
        (words(L.IMAGE, 0, 1, 1, 5, 5, L.END, *[0] * 7) + END, 1, "OK", "raw", [(1, 1, 5, 5)]),
        (words(0x8003, 9, 0x8003, 9) + IMAGE + END, 1, "OK", "raw", [(3, 4, 5, 6)]),
        (words(0x8003, 9, 0x8001, 9) + IMAGE + END, 1, "UNKNOWN_PREFIX", "raw", []),
        (L.PACKED + (32).to_bytes(4, "little") + zlib.compress(IMAGE + END), 1, "OK", "direct", [(3, 4, 5, 6)]),
        (L.PACKED + (31).to_bytes(4, "little") + zlib.compress(IMAGE + END), 1, "DAMAGED", "direct", []),
        (L.PACKED + b"\0\0\0\0junk", 1, "DAMAGED", "direct", []),
        (b"12345678" + L.PACKED + (44).to_bytes(4, "little") + zlib.compress(words(0x801C, 0, 0x80CE, 0) + IMAGE + words(1, 2) + END), 1, "NO_LAYOUT", "tagged", []),
        (b"12345678" + L.PACKED + (40).to_bytes(4, "little") + zlib.compress(words(0x801C, 0, 0x80CE, 0) + IMAGE + END), 1, "OK", "tagged", [(3, 4, 5, 6)]),
    ],
)
def test_streams_of_records(data, images, status, framing, boxes):
    found = L.read_boxes(data, images, True)
    assert (found["status"], found["framing"], [tuple(b.values()) for b in found["boxes"]]) == (status, framing, boxes)


def test_nulls_and_drawings(spark):
    assert L.read_boxes(None, 1, True) is None and L.read_drawing(None) is None and L.read_drawing(b"")["status"] == "TRUNCATED"
    frame = spark.createDataFrame([(None, None), (words(65, 1) + words(0x8007, 1, 2, 3, 4, 5) + IMAGE + words(66, 1) + END, 1)], "d binary, n int")
    got = [r["v"] for r in frame.select(L.drawings("d").alias("v")).collect()]
    assert got[0] is None and got[1]["order"] == "gvig" and [tuple(s) for s in got[1]["segments"]] == [(0x8007, 1, 2, 3, 4, 5)]
    assert [r["v"] and r["v"]["status"] for r in frame.select(L.image_boxes()("d", "n").alias("v")).collect()] == [None, "UNKNOWN_RECORD"]


def test_registers_of_glyphs():
    data = words(1, 9, M.STYLE, 5, M.AXIS_X, 7, 2, 9, M.STYLE, 6, 3, 9, M.AXIS_Y, 8, M.COLOUR, 1, L.END, 200, 4, 9) + END
    got = M.modelled(data)
    assert got["status"] == "OK" and [(g["tag"], g["style"], g["axis_x"], g["axis_y"], g["gray"]) for g in got["glyphs"]] == [(1, None, None, None, M.GRAY), (2, 5, 7, None, M.GRAY), (3, 6, None, None, M.GRAY), (4, 6, None, 8, 0.0)]
    assert M.modelled(None) is None and M.modelled(b"")["status"] == "TRUNCATED" and M.modelled(words(M.SHEAR, 1) + END)["status"] == "UNKNOWN_RECORD" and M.modelled(END) == {"status": "OK", "glyphs": []}


def test_rasters_evaluate_their_data_once(spark):
    """A value used inside a lambda is evaluated for each element, and nested ones multiply."""
    own = F.col("own_data")
    for made in (rasters.rows(own, F.lit(2)), rasters.upside_down(own, F.lit(2)), rasters.padded(rasters.upside_down(own, F.lit(2)), 13, 2, 0), rasters.one_bits(own), rasters.other_bytes(own, 0), rasters.candidates(own, 13, 2)):
        assert str(made).count("own_data") == 1


def test_rasters_of_few_bytes_are_spread(spark, sf):
    from quarry.plans import inspections

    assert inspections.QUERIES["run_bitmap_verification"](spark, sf).rdd.getNumPartitions() >= 4


def test_rasters(spark):
    data = F.lit(bytes(range(12)))
    assert bytes(value(spark, rasters.crop(data, F.lit(4), F.lit(1), F.lit(1), F.lit(2), F.lit(2)))) == bytes([5, 6, 9, 10])
    assert value(spark, rasters.crop(data, F.lit(4), F.lit(3), F.lit(1), F.lit(2), F.lit(2))) is None
    assert bytes(value(spark, rasters.upside_down(data, F.lit(4)))) == bytes([8, 9, 10, 11, 4, 5, 6, 7, 0, 1, 2, 3])
    assert value(spark, rasters.one_bits(F.lit(b"\xff\x01"))) == 9 and value(spark, rasters.one_bits(F.lit(b""))) == 0
    assert value(spark, rasters.zero_suffix(F.lit(b"abcd"), F.lit(b"ab\0\0"))).asDict() == {"prefix": 2, "suffix": 2}
    assert value(spark, rasters.zero_suffix(F.lit(b"abcd"), F.lit(b"ab\0x"))) is None and value(spark, rasters.zero_suffix(F.lit(b"ab"), F.lit(b"ab"))) is None
    assert value(spark, rasters.numeric_candidates(F.lit(b"\x01"))) == []


def test_edits_refuse_what_does_not_fit(spark):
    assert value(spark, X.overlaid(F.lit(b"abc"), F.lit(b"XY"), F.lit(2))) is None and bytes(value(spark, X.overlaid(F.lit(b"abc"), F.lit(b"XY"), F.lit(1)))) == b"aXY"
    assert value(spark, X.lowest_bit_flipped(F.lit(b"a"), F.lit(1))) is None and bytes(value(spark, X.lowest_bit_flipped(F.lit(b"a"), F.lit(0)))) == b"`"
    assert value(spark, X.transplanted(F.lit(b"abcd"), F.lit(b"wx"), F.lit(1), F.lit(2))) is None
    assert value(spark, X.content_replaced(F.lit(b"abcd"), F.lit(b"ZZ"), F.lit(1), F.sha2(F.lit(b"xx"), 256))) is None
    same = value(spark, X.completions(F.lit(b"\1\2\3"), F.array(F.lit(0)), 3, 4))
    assert (same["entries"], same["beyond"], same["undetermined"]) == (1, 0, False) and value(spark, X.completions(F.lit(b""), F.array(F.lit(2)), 3, 4))["undetermined"]


def test_reference_chains(spark):
    edges = [(i, i + 1) for i in range(16)] + [(16, None), (50, 51), (51, 50), (60, 60), (70, 99), (80, 0)]
    got = {r["node"]: (r["target"], r["steps"], r["status"]) for r in P.resolved(spark.createDataFrame(edges, "node int, next int"), 16).collect()}
    assert got[0] == (16, 16, "RESOLVED") and got[16] == (16, 0, "RESOLVED") and got[15] == (16, 1, "RESOLVED")
    assert all(got[k] == (None, None, "REFUSED") for k in (50, 51, 60, 70, 80))


def test_owners_and_routes(spark):
    found = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "owner int, paths array<string>")
    wanted = spark.createDataFrame([(1, ["a"]), (2, ["c"]), (3, ["d"])], "owner int, paths array<string>")
    assert sorted(r["owner"] for r in P.owners_differ(found, wanted, "owner").collect()) == [2, 3]
    asked = lambda *p: F.array(*map(F.lit, p)) if p else F.lit(None).cast("array<int>")
    assert value(spark, P.route(asked(), F.lit(3))) == [1, 2, 3] and value(spark, P.route(asked(3, 1), F.lit(3))) == [3, 1]
    assert value(spark, P.route(asked(4), F.lit(3))) is None and value(spark, P.route(asked(1, 1), F.lit(3))) is None and value(spark, P.route(asked(), F.lit(0))) is None


def test_edges_markers_and_palettes(spark):
    frame = bytes([1, 1, 1, 3, 9, 4, 2, 2, 2])
    edges = lambda d, **c: value(spark, rasters.edges_are(F.lit(d), F.lit(3), c))
    assert edges(frame, top=1, bottom=2, left=3, right=4) and not edges(frame, top=2) and not edges(frame[:6], top=1) and not edges(b"", top=1)
    cut = lambda m: value(spark, rasters.marked_crop(F.lit(frame), F.lit(3), m, F.lit(1), F.lit(1), F.lit(1), F.lit(1)))
    assert bytes(cut([(0, 1), (8, 2)])) == b"\t" and cut([(0, 2)]) is None and cut([(99, 1)]) is None
    fit = lambda n: value(spark, rasters.palette_fit(F.lit(b"x" * n), F.lit(1)))
    assert [fit(n) for n in (6, 3, 9, 7, 0)] == ["EXACT", "SHORT", "EXTRA", "UNALIGNED", "SHORT"]
