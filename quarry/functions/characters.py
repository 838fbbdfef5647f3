"""Character codes, titles and destinations of page formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How many numbers each kind of destination takes.
ARITY = {"Fit": 0, "FitB": 0, "FitBH": 1, "FitBV": 1, "FitH": 1, "FitR": 4, "FitV": 1, "XYZ": 3}
# Bytes of document text that are other characters than in Latin-1.
DOCUMENT_BYTES = {
    0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜", 0x80: "•", 0x81: "†", 0x82: "‡", 0x83: "…", 0x84: "—", 0x85: "–", 0x86: "ƒ", 0x87: "⁄", 0x88: "‹", 0x89: "›", 0x8A: "−", 0x8B: "‰",
    0x8C: "„", 0x8D: "“", 0x8E: "”", 0x8F: "‘", 0x90: "’", 0x91: "‚", 0x92: "™", 0x93: "ﬁ", 0x94: "ﬂ", 0x95: "Ł", 0x96: "Œ", 0x97: "Š", 0x98: "Ÿ", 0x99: "Ž", 0x9A: "ı", 0x9B: "ł", 0x9C: "œ", 0x9D: "š", 0x9E: "ž", 0xA0: "€",
}


def character(code: Column, ranges: list[tuple[int, int, int]], aliases: dict[int, str], fallback: Column | None = None) -> Column:
    """The character of a code: an alias, else the code less the offset of its range (first, last, offset), else ``fallback``."""
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<int,string>")
    found = F.try_element_at(named, code.cast("int"))
    for first, last, offset in ranges:
        found = F.coalesce(found, F.when(code.between(first, last), F.decode(F.unhex(F.lpad(F.hex(code - offset), 8, "0")), "UTF-32")))
    return F.coalesce(found, fallback) if fallback is not None else found


def destination(kind: Column, numbers: Column) -> Column:
    """A tagged destination, or null where its kind is unknown or takes another number of numbers."""
    arity = F.try_element_at(F.create_map(*[F.lit(x) for pair in ARITY.items() for x in pair]), kind)
    return F.when(arity == F.size(numbers), F.struct(kind.alias("kind"), numbers.alias("numbers")))


def document_title(data: Column) -> Column:
    """Text by its mark: UTF-16 of either order, UTF-8, or the single bytes of documents."""
    mark = lambda n: F.hex(F.substring(data, 1, n))
    rest = lambda n: F.substring(data, F.lit(n + 1), F.octet_length(data))
    plain = F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, DOCUMENT_BYTES)), "".join(DOCUMENT_BYTES.values()))
    return F.when(mark(2) == "FEFF", F.decode(rest(2), "UTF-16BE")).when(mark(2) == "FFFE", F.decode(rest(2), "UTF-16LE")).when(mark(3) == "EFBBBF", F.decode(rest(3), "UTF-8")).otherwise(plain)


def packed_bits(samples: Column, white: int = 255) -> Column:
    """Bytes that are all 0 or ``white``, eight to a byte with 1 for 0; null for any other byte or a number that is no multiple of eight."""
    pairs = F.regexp_extract_all(F.hex(samples), F.lit("(..)"), F.lit(1))
    binary = (F.octet_length(samples) % 8 == 0) & F.forall(pairs, lambda p: p.isin("00", f"{white:02X}"))
    bits = F.array_join(F.transform(pairs, lambda p: F.when(p == "00", "1").otherwise("0")), "")
    eights = F.regexp_extract_all(bits, F.lit("(.{8})"), F.lit(1))
    return F.when(binary, F.unhex(F.array_join(F.transform(eights, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), "")))
