"""Addresses as column expressions: their parts, and relative references resolved against a base (RFC 3986, 5.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of any reference, after the appendix of that standard; groups 2, 4, 5, 7 and 9, of which 1, 3, 6 and 8 tell if they are there.
PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _part(c: Column, group: int, there: int) -> Column:
    """A part, null where its delimiter is missing."""
    return F.when(F.regexp_extract(c, PARTS, there) != "", F.regexp_extract(c, PARTS, group))


def without_dots(path: Column) -> Column:
    """The path without '.' and '..' segments; '..' at the root stays there; a last one leaves its slash."""
    s = F.split(path, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(s, F.lit(2), F.size(s)), F.slice(s, F.lit(1), F.lit(1)), step)
    last = F.element_at(s, -1)
    out = F.array_join(F.when((last == ".") | (last == ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/"), out).otherwise(path)


def resolved(base: Column, ref: Column) -> Column:
    """The address that ref means on the page base, without its fragment; null if either is null.

    base is an absolute address; schemes and hosts stay as they are written.
    """
    scheme, host, path, query = _part(ref, 2, 1), _part(ref, 4, 3), F.regexp_extract(ref, PARTS, 5), _part(ref, 7, 6)
    own_scheme, own_host, own_path, own_query = _part(base, 2, 1), _part(base, 4, 3), F.regexp_extract(base, PARTS, 5), _part(base, 7, 6)
    folder = F.when(own_host.isNotNull() & (own_path == ""), F.lit("/")).otherwise(F.regexp_replace(own_path, "[^/]*$", ""))
    whole = scheme.isNotNull() | host.isNotNull()
    to_path = F.when(whole | path.startswith("/"), without_dots(path)).when(path == "", own_path).otherwise(without_dots(F.concat(folder, path)))
    to_query = F.when(whole | (path != ""), query).otherwise(F.coalesce(query, own_query))
    to_host = F.when(whole, host).otherwise(own_host)
    text = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    out = F.concat(text("", F.coalesce(scheme, own_scheme), ":"), text("//", to_host), to_path, text("?", to_query))
    return F.when(base.isNotNull() & ref.isNotNull(), out)
