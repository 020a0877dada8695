"""What a fetcher may open: public addresses over http or https, at every redirect."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions import urls as U

REDIRECTS = 5


def _public(address: str) -> bool:
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast and not ip.is_reserved


@F.pandas_udf(BooleanType())
def public_addresses(addresses: pd.Series) -> pd.Series:
    """Whether a host's resolved addresses are all public; none at all aren't."""
    return addresses.map(lambda own: own is not None and len(own) > 0 and all(_public(a) for a in own))


def allowed(hops: Column) -> Column:
    """Whether each hop (url, addresses) of a fetch may be opened, the redirects not being too many."""
    web = F.forall(hops, lambda h: F.lower(h["url"]).rlike("^https?://") & (U.host(h["url"]) != ""))
    addresses = F.flatten(F.transform(hops, lambda h: F.when(F.size(h["addresses"]) > 0, h["addresses"]).otherwise(F.array(F.lit("")))))
    return F.coalesce((F.size(hops).between(1, REDIRECTS + 1)) & web & public_addresses(addresses), F.lit(False))
