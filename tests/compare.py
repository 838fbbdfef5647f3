"""Rows of a query against rows of its SQL, without order."""

import decimal
import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted("|".join(plain(r[c]) for c in columns) for r in df.select(*columns).collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted("|".join(plain(r[i]) for i in at) for r in found.fetchall())
