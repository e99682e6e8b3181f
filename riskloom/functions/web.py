"""Expressions for page-visit rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that are not page views, and the masks of anonymised addresses.
API_PREFIX, STATIC_PREFIX, HEALTH_PATH = "/api/", "/static", "/health"
LAST_PART_MASK = "xxx"
FULL_MASK = "xxx.xxx.xxx.xxx"
USER_AGENT_LIMIT = 500

# Rules are tried in order; the first that matches names the family.
BROWSER_RULES = (
    ("Edge Mobile", r"Edg(A|iOS)/|Edge/.*Mobile|Mobile.*Edge/"),
    ("Edge", r"Edge?/"),
    ("Opera", r"OPR/|Opera"),
    ("Samsung Internet", r"SamsungBrowser/"),
    ("Firefox iOS", r"FxiOS/"),
    ("Firefox Mobile", r"(Android|Mobile).*Firefox/"),
    ("Firefox", r"Firefox/"),
    ("Chrome Mobile iOS", r"CriOS/"),
    ("Chrome Mobile", r"Android.*Chrome/[0-9.]+ Mobile"),
    ("Chrome", r"Chrome/"),
    ("Mobile Safari", r"(iPhone|iPad|iPod).*Version/.*Safari/"),
    ("Safari", r"Version/.*Safari/"),
    ("IE", r"MSIE |Trident/"),
    ("curl", r"^curl/"),
)
DEVICE_RULES = (
    ("iPad", r"iPad"),
    ("iPhone", r"iPhone"),
    ("Spider", r"(?i)bot|crawler|spider"),
    ("Generic Smartphone", r"Android.*Mobile"),
    ("Generic Tablet", r"Android"),
    ("Mac", r"Macintosh"),
)
OS_RULES = (
    ("Windows", r"Windows NT"),
    ("iOS", r"iPhone|iPad"),
    ("Android", r"Android"),
    ("Mac OS X", r"Mac OS X"),
    ("Linux", r"Linux"),
)


def is_page_view(path: Column) -> Column:
    return ~path.startswith(API_PREFIX) & ~path.startswith(STATIC_PREFIX) & (path != HEALTH_PATH)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """First entry of a forwarded list; a single forwarded value is taken as it is."""
    first = F.btrim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(F.contains(forwarded, F.lit(",")), first).otherwise(forwarded), peer)


def anonymize_ip(ip: Column) -> Column:
    """Mask the last of four dotted parts; mask everything else whole; empty becomes null."""
    dots = F.length(ip) - F.length(F.replace(ip, F.lit("."), F.lit("")))
    masked = F.concat(F.substring_index(ip, ".", 3), F.lit("." + LAST_PART_MASK))
    return F.when(ip.isNull() | (ip == ""), F.lit(None).cast("string")).when(dots == 3, masked).otherwise(FULL_MASK)


def family(agent: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Family named by the first matching rule, ``Other`` for an unknown agent."""
    chain = F.when(agent.isNull() | (agent == ""), F.lit("Other"))
    for name, pattern in rules:
        chain = chain.when(F.rlike(agent, F.lit(pattern)), F.lit(name))
    return chain.otherwise("Other")


def or_unknown(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), "Unknown").otherwise(value)
