"""URL columns built from ``try_parse_url`` and regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import let

# --- fixed values: parameters and suffixes that do not identify a file --------
TRACKING_PARAM = r"utm_[a-z_]*|fbclid|gclid|yclid|ysclid|igshid|mc_[ce]id|_ga|_gl|spm|ref|referrer|source|from"
SIZE_PARAM = r"w|h|width|height|size|resize|fit|q|quality|dpr|crop|format|auto|sw|sh|rev|v|cb"
SIZE_SUFFIX = (
    r"(?i)[-_](?:\d{2,5}x\d{2,5}|thumbnail|thumb|small|medium|large|scaled|resized|preview)(?=\.[a-z0-9]{2,5}$)"
)
RETINA_SUFFIX = r"(?i)@[1-4]x(?=\.[a-z0-9]{2,5}$)"
MEDIA_THUMB = r"(?i)^/wikipedia/([a-z-]+)/thumb/([0-9a-f])/([0-9a-f]{2})/([^/]+)/.+$"
NON_PHOTO_EXTENSION = r"(?i)\.(?:svg|gif|ico|bmp|tiff?)(?:$|[?#])"


#: What a parser refuses in an address and a browser writes for it.
ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "\\": "/", "^": "%5E", "`": "%60", "{": "%7B", "|": "%7C", "}": "%7D"}
REFUSED = r'[\s"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})'


def parseable(url: Column) -> Column:
    """The trimmed address with the characters that a parser refuses escaped."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\n\r]", ""), "%(?![0-9A-Fa-f]{2})", "%25")
    for char, escape in ESCAPES.items():
        clean = F.replace(clean, F.lit(char), F.lit(escape))
    return F.when(F.trim(url).rlike(REFUSED), clean).otherwise(F.trim(url))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def url_host(col: Column) -> Column:
    """Lower-case host without ``www.``; null when there is none."""
    return strip_www(F.try_parse_url(parseable(col), F.lit("HOST")))


def canonical_url(col: Column) -> Column:
    """One string per image file, whatever size, tracking or scheme its URL carries."""
    def path_of(url: Column) -> Column:
        return let(F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), lambda p: F.when(
            p.rlike(MEDIA_THUMB), F.regexp_replace(p, MEDIA_THUMB, "/wikipedia/$1/$2/$3/$4")
        ).otherwise(F.regexp_replace(F.regexp_replace(p, RETINA_SUFFIX, ""), SIZE_SUFFIX, "")))

    def query_of(url: Column) -> Column:
        query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
        pairs = F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING_PARAM}|{SIZE_PARAM})(?:=|$)"),
        )
        # Sort by key only (equal keys keep their order): key, then position.
        keyed = F.array_sort(F.transform(
            pairs, lambda p, i: F.struct(F.split(p, "=").getItem(0).alias("k"), i.alias("i"), p.alias("p"))))
        joined = F.array_join(F.transform(keyed, lambda s: F.when(s["p"].contains("="), s["p"]).otherwise(
            F.concat(s["p"], F.lit("=")))), "&")
        return F.when(query == "", "").otherwise(let(joined, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise("")))

    def rebuilt(url: Column) -> Column:
        return F.when(
            F.lower(url).rlike("^https?://"),
            F.coalesce(F.concat(F.lit("https://"), strip_www(F.try_parse_url(url, F.lit("HOST"))), path_of(url), query_of(url)), url),
        ).otherwise(url)

    return let(parseable(col), rebuilt)


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def host_in_list(host: Column, domains: list[str]) -> Column:
    """Equal to, or below, one of the listed domains (a small constant list, so one compiled pattern)."""
    listed = "|".join(d.replace(".", "[.]") for d in domains)
    return strip_www(host).rlike(f"(?:^|[.])(?:{listed})$")


def official_hosts(domain: Column) -> Column:
    """A two-label country domain also owns its academic twins; never the other way round."""
    clean = strip_www(domain)
    parts = F.split(clean, r"\.")
    two = (F.size(parts) == 2) & (parts[0] != "") & F.try_element_at(parts, F.lit(2)).rlike("^[a-z]{2}$")
    twins = F.array(clean, *[
        F.concat(parts[0], F.lit(f".{level}."), F.try_element_at(parts, F.lit(2))) for level in config.ACADEMIC_LEVELS
    ])
    return F.when(two, twins).otherwise(F.array(clean))


def source_type(host: Column, own_suffix: Column) -> Column:
    """official > encyclopedic > news > social > unknown (stock, aggregator) > independent."""
    stock = host_in_list(host, config.STOCK_DOMAINS) | host_in_list(host, config.AGGREGATOR_DOMAINS)
    return (
        F.when(own_suffix, "official")
        .when(host_in_list(host, config.ENCYCLOPEDIC_DOMAINS), "encyclopedic")
        .when(host_in_list(host, config.NEWS_DOMAINS), "news")
        .when(host_in_list(host, config.SOCIAL_DOMAINS), "social")
        .when(stock, "unknown")
        .otherwise("independent")
    )


def stable_id(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical), 1, 12)
