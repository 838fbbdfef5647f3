"""Packed rasters as column expressions: bytes, crops, row orders, spare bits, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def byte_at(data: Column, at: Column) -> Column:
    """The byte at a place from 0, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def from_byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.bitwiseAND(255)), 2, "0"))


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _range(n: Column) -> Column:
    """0 to n - 1; empty for n of 0."""
    return _bound(n, lambda n: F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(1), F.greatest(n, F.lit(0))))


def rows(data: Column, stride: Column) -> Column:
    return _bound(data, lambda d: F.transform(_range((F.octet_length(d) / stride).cast("int")), lambda r: F.substring(d, r * stride + 1, stride)))


def crop(data: Column, stride: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Bytes of a rectangle, in bytes and rows; null where it is not inside."""
    inside = (left >= 0) & (top >= 0) & (width > 0) & (height > 0) & (left + width <= stride) & ((top + height) * stride <= F.octet_length(data))
    return F.when(inside, _joined(F.transform(_range(height), lambda r: F.substring(data, (top + r) * stride + left + 1, width))))


def upside_down(data: Column, stride: Column) -> Column:
    return _joined(F.reverse(rows(data, stride)))


def padded(data: Column, width: int, stride: int, bit: int) -> Column:
    """One-bit rows whose spare bits are all ``bit``; stride is the width's bytes."""
    spare = (1 << (-width % 8)) - 1
    last = lambda row: from_byte(byte_at(row, F.lit(stride - 1)).bitwiseOR(F.lit(spare)) if bit else byte_at(row, F.lit(stride - 1)).bitwiseAND(F.lit(255 - spare)))
    return _joined(F.transform(rows(data, F.lit(stride)), lambda row: F.concat(F.substring(row, 1, stride - 1), last(row))))


def one_bits(data: Column) -> Column:
    seven = lambda d, i: F.conv(F.hex(F.substring(d, i * 7 + 1, F.lit(7))), 16, 10).cast("long")
    return _bound(data, lambda d: F.aggregate(_range(F.ceil(F.octet_length(d) / 7).cast("int")), F.lit(0), lambda n, i: n + F.bit_count(seven(d, i))))


def other_bytes(data: Column, value: int) -> Column:
    """How many bytes are not ``value``: of white samples, how many are not white."""
    return _bound(data, lambda d: F.octet_length(d) - F.size(F.filter(_range(F.octet_length(d)), lambda i: byte_at(d, i) == value)))


def candidates(data: Column, width: int, stride: int) -> Column:
    """For both row orders and both fillings of the spare bits: order, pad, one bits and hash."""

    def of(order: str, image: Column) -> Column:
        described = lambda bit: lambda x: F.struct(F.lit(order).alias("order"), F.lit(bit).alias("pad"), one_bits(x).alias("ones"), F.sha2(x, 256).alias("sha256"))
        return F.array(*[_bound(padded(image, width, stride, bit), described(bit)) for bit in (0, 1)])

    return _bound(data, lambda d: F.concat(of("top", d), _bound(upside_down(d, F.lit(stride)), lambda image: of("bottom", image))))


def filled_grid(left: Column, top: Column, right: Column, bottom: Column, width: int, height: int) -> Column:
    """A grid of bytes, 1 inside the rectangle and 0 outside."""
    cell = lambda i: F.when((i % width >= left) & (i % width < right) & ((i / width).cast("int") >= top) & ((i / width).cast("int") < bottom), "01").otherwise("00")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), cell), ""))


def zero_suffix(intact: Column, damaged: Column) -> Column:
    """struct(prefix, suffix): where two values of one length first differ, if all that follows in ``damaged`` is zero; null otherwise."""
    n = F.octet_length(intact)
    differs = F.filter(_range(n), lambda i: F.substring(intact, i + 1, F.lit(1)) != F.substring(damaged, i + 1, F.lit(1)))
    first = F.get(differs, F.lit(0))
    zero = F.forall(F.filter(_range(n), lambda i: i >= first), lambda i: byte_at(damaged, i) == 0)
    return F.when((n == F.octet_length(damaged)) & first.isNotNull() & zero, F.struct(first.alias("prefix"), (n - first).alias("suffix")))


def _number(data: Column, at: Column, width: int, order: str) -> Column:
    """The unsigned integer of ``width`` bytes at a place."""
    digits = [F.hex(F.substring(data, at + k + 1, F.lit(1))) for k in range(width)]
    return F.conv(F.concat(*(digits if order == "big" else digits[::-1])), 16, 10).cast("long")


def numeric_candidates(data: Column, widths: tuple[int, ...] = (2, 4)) -> Column:
    """array<struct(at, width, order, signed, value)>: all integers of fixed width that bytes can be read as."""

    def readings(width: int, order: str, signed: bool) -> Column:
        def one(at: Column) -> Column:
            number = _number(data, at, width, order)
            value = F.when(number >= 1 << (8 * width - 1), number - (1 << 8 * width)).otherwise(number) if signed else number
            return F.struct(at.alias("at"), F.lit(width).alias("width"), F.lit(order).alias("order"), F.lit(signed).alias("signed"), value.alias("value"))

        return F.transform(_range(F.octet_length(data) - (width - 1)), one)

    return F.concat(*[readings(w, o, s) for w in widths for o in ("little", "big") for s in (False, True)])


def _column_is(lines: Column, place: Column, wanted: str) -> Column:
    return F.forall(lines, lambda row: F.hex(F.substring(row, place, F.lit(1))) == wanted)


def edges_are(data: Column, stride: Column, colours: dict[str, int]) -> Column:
    """Whether each named edge (top, bottom, left, right) of a raster of bytes has one colour all along; corners belong to top and bottom."""
    lines = rows(data, stride)
    inner = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    whole = {"top": F.get(lines, F.lit(0)), "bottom": F.get(lines, F.size(lines) - 1)}
    good = F.size(lines) >= 3
    for name, value in colours.items():
        wanted = f"{value:02X}"
        if name in whole:
            good = good & (F.hex(whole[name]) == F.repeat(F.lit(wanted), stride.cast("int")))
        else:
            good = good & _column_is(inner, F.lit(1) if name == "left" else stride, wanted)
    return F.coalesce(good, F.lit(False))


def marked_crop(data: Column, stride: Column, markers: list[tuple[int, int]], left: Column, top: Column, width: Column, height: Column) -> Column:
    """A rectangle of a raster in which every marker (place, byte) is as it must be; null where one is not."""
    sure = F.lit(True)
    for place, value in markers:
        sure = sure & (byte_at(data, F.lit(place)) == value)
    return F.when(F.coalesce(sure, F.lit(False)), crop(data, stride, left, top, width, height))


def palette_fit(palette: Column, bits: Column, entry_bytes: int = 3) -> Column:
    """EXACT, SHORT or EXTRA: a palette against what indices of so many bits can reach; UNALIGNED where its bytes make no whole entries."""
    size, wanted = F.octet_length(palette), entry_bytes * F.call_function("shiftleft", F.lit(1), bits.cast("int"))
    return F.when(size % entry_bytes != 0, "UNALIGNED").when(size < wanted, "SHORT").when(size > wanted, "EXTRA").otherwise("EXACT")
