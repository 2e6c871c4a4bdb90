"""Absolute http(s) URLs: parts with default ports, joining a target to a base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, let

# scheme, authority, rest
_URL = r"(?s)^(https?)://([^/]*)(/.*)?\z"


def url_parts(url: Column) -> Column:
    """STRUCT<host, port, path, secure>; NULL for anything that is not a valid URL.

    The port is what follows the last ':' of the authority and must fit 16 bits.
    """
    return let(
        F.struct(
            first_match(url, _URL, 1).alias("scheme"),
            F.regexp_extract(url, _URL, 2).alias("authority"),
            F.regexp_extract(url, _URL, 3).alias("path"),
        ),
        _parts,
    )


def _parts(u: Column) -> Column:
    authority, secure = u["authority"], u["scheme"] == "https"
    port_text = F.when(F.contains(authority, F.lit(":")), F.substring_index(authority, ":", -1))
    default = F.when(secure, F.lit(443)).otherwise(F.lit(80)).cast("bigint")
    port = F.when(port_text.isNull(), default).when(
        port_text.rlike(r"^\+?[0-9]+\z"), port_text.try_cast("bigint")
    )
    host = F.left(authority, F.length(authority) - F.coalesce(F.length(port_text) + 1, F.lit(0)))
    return let(
        F.struct(
            host.alias("host"),
            port.alias("port"),
            F.when(u["path"] == "", F.lit("/")).otherwise(u["path"]).alias("path"),
            secure.alias("secure"),
        ),
        lambda p: F.when((p["host"] != "") & p["port"].between(0, 65535) & p["secure"].isNotNull(), p),
    )


def absolute_url(parts: Column) -> Column:
    return let(parts, _absolute)


def _absolute(parts: Column) -> Column:
    scheme = F.when(parts["secure"], F.lit("https")).otherwise(F.lit("http"))
    return F.concat(
        scheme, F.lit("://"), parts["host"], F.lit(":"), parts["port"].cast("string"), parts["path"]
    )


def resolve_target(base: Column, target: Column) -> Column:
    """Absolute form of a target, joined to the base unless already absolute."""
    is_absolute = F.startswith(target, F.lit("http://")) | F.startswith(target, F.lit("https://"))
    rooted = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target))
    joined = F.concat(F.rtrim(base, F.lit("/")), rooted)
    return F.when(is_absolute, target).otherwise(joined)
