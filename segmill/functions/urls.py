"""URL parts by one lenient pattern (Spark's own URL parser rejects too many real hosts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_PATTERN = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?"
    r"(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?"
)


def _group(url: Column, index: int) -> Column:
    return F.regexp_extract(F.trim(url), URL_PATTERN, index)


def scheme(url: Column) -> Column:
    return F.lower(_group(url, 1))


def userinfo(url: Column) -> Column:
    return _group(url, 2)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_group(url, 3)), r"\.+$", "")


def port(url: Column) -> Column:
    return _group(url, 4).try_cast("int")


def path(url: Column) -> Column:
    return _group(url, 5)


def query(url: Column) -> Column:
    return _group(url, 6)


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def canonical(url: Column) -> Column:
    """Identity of a URL: no fragment, folded scheme and host, no default port, path at least ``/``."""
    number = port(url)
    default = ((scheme(url) == "http") & (number == 80)) | ((scheme(url) == "https") & (number == 443))
    authority = F.when(
        number.isNotNull() & (number != 0) & ~default,
        F.concat_ws(":", host(url), number.cast("string")),
    ).otherwise(host(url))
    search = F.when(query(url) == "?", F.lit("")).otherwise(query(url))
    return F.concat(
        scheme(url),
        F.lit("://"),
        authority,
        F.when(path(url) == "", F.lit("/")).otherwise(path(url)),
        search,
    )


def host_matches(host_column: Column, domain: str) -> Column:
    """Host equals ``domain`` or is below it."""
    return (host_column == domain) | host_column.endswith("." + domain)


def ipv6_groups(host_column: Column) -> Column:
    """The eight numbers of a bracketed IPv6 address, null for any other host."""
    body = F.regexp_extract(host_column, r"^\[([0-9a-f:]*:[0-9a-f:.]*)\]$", 1)
    last = [F.regexp_extract(body, r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", k).try_cast("int") for k in range(1, 5)]
    tail = F.concat_ws(":", F.hex(last[0] * 256 + last[1]), F.hex(last[2] * 256 + last[3]))
    body = F.when(last[0].isNotNull(), F.concat(F.regexp_replace(body, r"[0-9.]+$", ""), tail)).otherwise(body)
    halves = F.transform(F.split(body, "::"), lambda half: F.array_remove(F.split(half, ":"), ""))
    right = F.coalesce(F.get(halves, 1), F.array().cast("array<string>"))
    missing = F.when(F.contains(body, F.lit("::")), F.greatest(F.lit(0), F.lit(8) - F.size(halves[0]) - F.size(right))).otherwise(0)
    groups = F.concat(halves[0], F.array_repeat(F.lit("0"), missing), right)
    numbers = F.transform(groups, lambda group: F.conv(group, 16, 10).try_cast("int"))
    return F.when((body != "") & (F.size(numbers) == 8), numbers)
