"""Request URIs and referers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:\[\] \\^`{|}]*)(?::\d*)?(?:[/?#]|$)"


def raw_query(uri: Column) -> Column:
    """Text after the first question mark, not decoded."""
    at = F.instr(uri, "?")
    return F.when(at > 0, F.substr(uri, at + F.lit(1))).otherwise(F.lit(""))


def decoded_path(uri: Column) -> Column:
    """The percent-decoded path of a request URI, NULL if the URI is not valid; ``+`` stays as it is."""
    path = F.substring_index(uri, "?", 1)
    absolute = F.regexp_extract(path, _SCHEME + r"(?://[^/]*)?(/.*)?$", 1)
    form = F.when(path.startswith("/") | (path == "*"), path).when(path.rlike(_SCHEME), absolute)
    form = F.when(uri.rlike(r"[\x00-\x1f\x7f]"), F.lit(None)).otherwise(form)
    return F.try_url_decode(F.replace(form, F.lit("+"), F.lit("%2B")))


def path_level(path: Column, level: int) -> Column:
    """The first one to three parts of a decoded path, '' if there are fewer; NULL paths have none."""
    parts = F.split(path, "/")
    size = F.size(parts)
    if level == 1:
        value = F.when(F.length(path) == 0, "").when(size == 1, "/").otherwise(F.concat(F.lit("/"), F.try_element_at(parts, F.lit(2))))
    else:
        value = F.when(size > level, F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, level), "/"))).otherwise("")
    return F.coalesce(value, F.lit(""))


def traffic_source(referer: Column, uri: Column) -> Column:
    """The first utm_source of the URI, else the referer's host without port and one leading www."""
    campaign = F.regexp_extract(uri, r"[?&]utm_source=([^&]+)", 1)
    host = F.regexp_replace(F.regexp_extract(referer, _HOST, 1), r"^\[|\]$", "")
    host = F.when(F.regexp_extract(referer, r"^[^?#]*", 0).rlike(_BAD_ESCAPE), "").otherwise(F.regexp_replace(host, r"^www\.", ""))
    return F.coalesce(F.when(campaign != "", campaign).otherwise(host), F.lit(""))
