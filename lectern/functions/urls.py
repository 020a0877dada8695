"""Column functions over URLs. The two ways to normalise serve different ends; they aren't one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def index_key(url: Column) -> Column:
    """Lower case, without scheme, leading www., query, fragment and trailing slashes."""
    low = F.lower(url)
    host = F.regexp_replace(F.regexp_extract(low, _PARTS, 2), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(low, _PARTS, 3), r";[^/]*$", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def host_path(url: Column) -> Column:
    """Scheme and host in lower case, the path as it is; no query, fragment or trailing slash."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r";[^/]*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(url, _PARTS, 2)), path)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL, given the page it stands on; without `..` steps."""
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([^:/?#]+://[^/]*(?:/.*)?)/[^/]*$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(root), F.lit("/"), link))
    )
