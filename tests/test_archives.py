"""Archives and portable pages on damaged inputs."""

import pytest

from quarry.sources import archives as Z
from quarry.sources import framed as R
from quarry.sources import pdf_pages as P
from quarry.sources.pdf import Malformed

GOOD = Z.write_archive([("a", b"one" * 50), ("b", b"")])


def test_archives():
    read = Z.read_archive(GOOD)
    assert read["status"] == "COMPLETE" and [(m["name"], m["size"], m["status"], m["data"]) for m in read["members"]] == [("a", 150, "PASS", b"one" * 50), ("b", 0, "PASS", b"")]
    assert Z.read_archive(None) is None and Z.read_archive(b"")["status"] == "NO_END"
    body = bytearray(GOOD)
    body[35] ^= 1  # inside the first member's packed bytes
    assert Z.read_archive(bytes(body))["members"][0]["status"] == "CONTENT" and Z.read_archive(bytes(body))["members"][0]["data"] is None
    name = bytearray(GOOD)
    name[30] ^= 1  # the local name
    assert Z.read_archive(bytes(name))["members"][0]["status"] == "LOCAL_RECORD"
    assert Z.read_archive(b"x" + GOOD)["status"] == "CENTRAL_RECORD" and Z.read_archive(GOOD[:-22] + b"x" + GOOD[-22:])["status"] == "GAP"


def test_frames():
    whole = b"\2\0\0\0ab\0\0\0\0"
    assert R.read_frames(whole, 9) == {"status": "COMPLETE", "frames": [b"ab", b""]} and R.read_frames(b"", 9)["status"] == "COMPLETE"
    assert R.read_frames(whole[:5], 9)["status"] == "TRUNCATED" and R.read_frames(whole + b"\1", 9) == {"status": "TRUNCATED", "frames": [b"ab", b""]}
    assert R.read_frames(whole, 1) == {"status": "LIMIT", "frames": []} and R.read_frames(None, 1) is None


def test_pages_refuse_what_does_not_close():
    for content in (b"Q", b"q", b"1 2 l S", b"EMC", b"1 g 1 cm", b"<41> Tj"):
        with pytest.raises(Malformed):
            P._Page().run(content)
    page = P._Page().run(b"q 2 0 0 2 1 1 cm 0 0 m 1 0 l 1 1 l h S Q 0 0 m 5 5 l n 3 w 9 9 m 9 8 l S")
    assert [(s["from"], s["to"], s["width"]) for s in page.segments] == [([1, 1], [3, 1], 1), ([3, 1], [3, 3], 1), ([3, 3], [1, 1], 1), ([9, 9], [9, 8], 3)] and page.order == ["v", "v"]


def test_operands_and_tables():
    assert P.first_unfinished(b"(a \\) <41) <41> [<< /A <4") == {"offset": 23, "arrays": 1, "dictionaries": 1}
    assert P.first_unfinished(b"% <41\n<42>") is None and P.first_unfinished(b"(never ends <41") is None and P.first_unfinished(b"<4g>") == {"offset": 0, "arrays": 0, "dictionaries": 0}
    rows = b"xref\n0 2\n0000000000 65535 f \n0000000017 00000 n \n5 1\n0000000099 00003 n \ntrailer"
    assert P.table_entry(rows, 0, 1) == {"offset": 17, "generation": 0, "in_use": True} and P.table_entry(rows, 0, 5)["generation"] == 3 and P.table_entry(rows, 0, 4) is None
    for bad in (rows[1:], rows.replace(b"00000 n", b"0000x n")):
        with pytest.raises(Malformed):
            P.table_entry(bad, 0, 1)
    with pytest.raises(Malformed):
        P.table_entry(rows, 0, 5, most=2)
