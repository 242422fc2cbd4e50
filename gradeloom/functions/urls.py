"""URL guard: https, a host, no user, and no host that is local or an address of a private range."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .workers import sent_by_value

sent_by_value(__name__)


def _public(host: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((host or "").strip("[]"))
    except ValueError:
        return True
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast)


@F.pandas_udf(BooleanType())
def public_address(hosts: pd.Series) -> pd.Series:
    return hosts.map(_public).astype(bool)


def safe(url: str) -> bool:
    """safe_url() of one URL, where a task itself follows it."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").lower().rstrip(".")
    except ValueError:
        return False
    local = host in ("localhost", "localhost.localdomain") or host.endswith(".local")
    return u.scheme == "https" and bool(host) and not (u.username or u.password) and not local and _public(host)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)


def named_host_ok(url: Column) -> Column:
    """The guard but for addresses."""
    host = F.regexp_replace(F.lower(host_of(url)), r"\.+$", "")
    user = F.regexp_extract(url, r"^[^:]*://([^/?#]*)@", 1)
    return F.lower(url).startswith("https://") & (host != "") & (~host.startswith("[") | host.endswith("]")) & (user == "") & ~host.isin("localhost", "localhost.localdomain") & ~host.endswith(".local")


def safe_url(url: Column) -> Column:
    """A row's host goes to Python only if it looks like an address; all rows pass that stage."""
    host = host_of(url)
    address = host.rlike(r"^[0-9.]+$|^\[")
    return F.coalesce(named_host_ok(url) & (~address | public_address(F.when(address, host))), F.lit(False))
