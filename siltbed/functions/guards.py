"""The driver-side guards of ``plans.spec`` as column expressions, for auditing whole tables of paths or addresses."""

from __future__ import annotations

import ipaddress
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.plans.spec import DEFAULT_PREFIX

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def path_from_template(template: Column, day: Column | date) -> Column:
    text = F.lit(day.isoformat()) if isinstance(day, date) else F.date_format(day, "yyyy-MM-dd")
    return F.replace(template, F.lit("{date}"), text)


def destination_allowed(path: Column, allowed_prefix: str = DEFAULT_PREFIX) -> Column:
    """False for traversal, also percent-encoded, and for paths outside the prefix."""
    bare = F.regexp_replace(path, "s3a?://", "")
    # url_decode would also turn '+' into a blank, which a path must keep.
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    text = F.coalesce(decoded, bare)
    return ~F.contains(text, F.lit("..")) & F.startswith(text, F.lit(allowed_prefix))


def _address_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    number = F.lit(0).cast("bigint")
    for position in range(4):
        number = number * 256 + F.get(parts, F.lit(position)).try_cast("bigint")
    return F.when(host.rlike(IPV4), number)


def host_allowed(url: Column, allowed: tuple[str, ...]) -> Column:
    """Exact host, sub-domain, or IPv4 address inside a listed network; an address without a host is refused."""
    if not allowed:
        return F.lit(True)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    verdict = F.lit(False)
    for entry in (item.strip() for item in allowed):
        try:
            network = ipaddress.ip_network(entry, strict=False)
        except ValueError:
            verdict = verdict | (host == entry) | F.endswith(host, F.lit(f".{entry}"))
        else:
            if network.version != 4:
                continue
            low, high = int(network.network_address), int(network.broadcast_address)
            verdict = verdict | F.coalesce(_address_number(host).between(low, high), F.lit(False))
    return F.coalesce(verdict, F.lit(False))
