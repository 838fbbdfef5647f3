"""Per-record callbacks as table functions: one input value, any number of rows, a limit instead of a cancel signal."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.sources.pdf import Malformed, tokens
from quarry.sources.records import glyph_columns


class GlyphRows:
    """(data, most): a row for each glyph of a record stream, then one that says how it ended."""

    def eval(self, data: bytes, most: int):
        if data is None:
            return
        status, offset, glyphs = glyph_columns(bytes(data), most or 65_536)
        for at, x, y, code in zip(*glyphs, strict=True):
            yield "glyph", at, x, y, code
        yield status, offset, None, None, None


class TokenRows:
    """(data): a row for each token of a page's contents, up to the first that is malformed."""

    def eval(self, data: bytes):
        if data is None:
            return
        try:
            for i, (kind, value, _) in enumerate(tokens(bytes(data))):
                yield i, kind, value.hex() if isinstance(value, bytes) else str(value)
        except Malformed as bad:
            yield -1, "malformed", str(bad)


def register(spark: SparkSession) -> None:
    """``glyph_rows(data, most)`` and ``token_rows(data)`` for LATERAL use in SQL."""
    spark.udtf.register("glyph_rows", udtf(GlyphRows, returnType="kind string, offset int, x int, y int, code int", useArrow=True))
    spark.udtf.register("token_rows", udtf(TokenRows, returnType="ordinal int, kind string, value string"))


def visitor(spark: SparkSession, name: str, function: Callable[[bytes], Iterable[tuple]], schema: str) -> None:
    """Register any function from bytes to rows as a table function."""

    class Rows:
        def eval(self, data: bytes):
            if data is not None:
                yield from function(bytes(data))

    spark.udtf.register(name, udtf(Rows, returnType=schema))
