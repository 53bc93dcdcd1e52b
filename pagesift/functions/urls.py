"""Expressions over addresses: parts, comparable form, classes. All stay within the JVM.

An address is read leniently: `parse_url` gives null for blanks or bars, these expressions do not. Null and malformed
addresses have an empty host; every flag is then false and every tier 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift import tables

AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
#: Parameters that only name where a visitor came from.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_social",
    "utm_brand", "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "srsltid", "mc_cid", "mc_eid", "igshid", "wbraid",
    "gbraid", "_ga", "_gl", "vero_id", "wickedid",
)


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(url: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(url), F.lit("")), r"(?U)^\s+|\s+$", "")


def raw_host(url: Column | str) -> Column:
    """Host in lower case, without user and port, `www.` kept; empty if there is none."""
    authority = F.regexp_extract(F.lower(trimmed(url)), AUTHORITY, 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")


def host_of(url: Column | str) -> Column:
    """Host without one leading `www.`."""
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def host_with_port(url: Column | str) -> Column:
    """What follows http:// or https:// up to the path, in lower case, `www.` and port kept."""
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"^https?://([^/?#]+)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(trimmed(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(trimmed(url), r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column | str) -> Column:
    q = query_of(url)
    return F.lower(F.concat(path_of(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def path_depth(url: Column | str) -> Column:
    """Slashes after the last `//`, a quarter each, 1 at most."""
    rest = F.element_at(F.split(F.coalesce(_c(url), F.lit("")), "//"), -1)
    return F.least(F.lit(1.0), (F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit("")))) / F.lit(4.0))


def learner_host(element: Column | str) -> Column:
    """Key of a host observation, which may be a bare host or an address."""
    e = F.lower(trimmed(element))
    h = raw_host(e)
    return F.regexp_replace(F.when(F.contains(e, F.lit("/")) & (h != ""), h).otherwise(e), r"^www\.", "")


def _decoded(text: Column) -> Column:
    """Percent-decoded, `+` kept; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def comparable(url: Column | str) -> Column:
    """Comparable form (U3): two spellings of one page are equal. Empty for a blank address.

    Without scheme, fragment, default port, tracking parameters and trailing slashes; parameters decoded, sorted and
    encoded again. A bad port or no host leaves the lower case of the whole.
    """
    # one pattern takes the address apart; every step below sees short parts only
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    spread = lambda s: F.struct(s.alias("s"), *[F.regexp_extract(s, parts, i).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query"), 1)])
    hosted = lambda u: let(F.struct(u.alias("u"), F.regexp_replace(F.lower(u["authority"]), r"^.*@", "").alias("h")), lambda x: F.struct(x["u"].alias("u"), F.regexp_replace(x["h"], r":[^:\]]*$", "").alias("host"), F.regexp_extract(x["h"], r":([^:\]]*)$", 1).alias("port")))
    return let(let(let(trimmed(url), spread), hosted), _comparable)


def _comparable(x: Column) -> Column:
    s, scheme, raw, port = x["u"]["s"], F.lower(x["u"]["scheme"]), x["host"], x["port"]
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.concat(raw, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    # parameters of the last segment, after a semicolon, are no part of the path
    path = F.regexp_replace(x["u"]["path"], r";[^/]*$", "")

    def safe(p: Column) -> Column:
        """Characters other than visible ASCII encoded; few addresses have any."""
        each = F.transform(F.split(p, ""), lambda c: F.when(c.rlike(r"^[!-~]?$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
        return F.when(p.rlike(r"^[!-~]*$"), p).otherwise(F.array_join(each, ""))

    def upper_escapes(p: Column) -> Column:
        pieces = F.transform(F.split(p, "%"), lambda x, i: F.when((i > 0) & x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1_000_000))).otherwise(x))
        return F.when(F.contains(p, F.lit("%")), F.array_join(pieces, "%")).otherwise(p)

    path = let(F.regexp_replace(let(let(path, safe), upper_escapes), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))

    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, 1, 1_000_000)).otherwise(F.lit(""))
        return F.struct(decoded(key).alias("k"), F.when(at > 0, decoded(F.regexp_replace(value, "^[^=]*=", ""))).otherwise("").alias("v"))

    def encoded(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def tail(q: Column) -> Column:
        pairs = F.filter(F.transform(F.filter(F.split(q, "&"), lambda p: p != ""), pair), lambda p: ~F.lower(p["k"]).isin(*TRACKING))
        kept = F.transform(F.array_sort(pairs), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"])))
        return F.when(q == "", "").otherwise(let(F.array_join(kept, "&"), lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")))

    whole = F.concat(host, path, let(x["u"]["query"], tail))
    bad = (raw == "") | ((port != "") & ~port.rlike(r"^[0-9]{1,5}$"))
    return F.when(s == "", "").when(bad, F.lower(s)).otherwise(whole)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    needles = F.array(*[F.lit(n) for n in needles])
    return let(text, lambda t: F.exists(needles, lambda n: F.contains(t, n)))


def any_pair(host: Column, rest: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in pairs])
    return let(F.struct(host.alias("host"), rest.alias("rest")), lambda u: F.exists(pairs, lambda x: F.contains(u["host"], x["h"]) & F.contains(u["rest"], x["p"])))


def blacklisted(url: Column | str, hosts: Iterable[str] = tables.BLACKLISTED_HOSTS, paths=tables.BLACKLISTED_PATHS) -> Column:
    """Listed host, or listed host and path together (U4)."""
    h = raw_host(url)
    return (h != "") & (contains_any(h, hosts) | any_pair(h, path_and_query(url), paths))


def low_value_tier(url: Column | str, hosts: Iterable[str] = tables.LOW_VALUE_HOSTS, paths: Iterable[str] = tables.LOW_VALUE_PATHS) -> Column:
    """2 for a shop host, 1 for a purchase or product path as it stands or decoded, else 0."""
    rest, paths = path_and_query(url), tuple(paths)
    return F.when(contains_any(raw_host(url), hosts), 2).when(contains_any(rest, paths) | contains_any(F.lower(_decoded(rest)), paths), 1).otherwise(0)


def text_soup(url: Column | str, hosts: Iterable[str] = tables.TEXT_SOUP_HOSTS, paths=tables.TEXT_SOUP_PATHS) -> Column:
    h = raw_host(url)
    return (h != "") & (contains_any(h, hosts) | any_pair(h, F.lower(path_of(url)), paths))


def under(host: Column, domains: Iterable[str]) -> Column:
    """Whether the host is one of the domains or below one (suffix match)."""
    ends = F.array(*[F.lit("." + d) for d in domains])
    return let(F.concat(F.lit("."), host), lambda dotted: F.exists(ends, lambda d: F.endswith(dotted, d)))


def report_mill(url: Column | str, domains: Iterable[str] = tables.REPORT_MILLS) -> Column:
    """A machine-translated page of a report seller."""
    return under(raw_host(url), domains) & F.lower(path_of(url)).rlike(r"^/(?:zh|cn)(?:[/\-]|$)|zh-cn")


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first, for equi-joins with tables of domains (U8)."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def skip_reason(l0_status: Column | str, l1_status: Column | str, l1_error: Column | str, url: Column | str) -> Column:
    """Why a page is not tried by the next, dearer level (U9); empty if it is."""
    a, b = _c(l0_status), _c(l1_status)
    gone, blocked = (404, 410), (403, 451)
    unread = F.contains(F.coalesce(_c(l1_error), F.lit("")), F.lit("codec can't decode")) & F.contains(F.lower(F.coalesce(_c(url), F.lit(""))), F.lit("pdf"))
    return (
        F.when(F.coalesce(a.isin(*gone), F.lit(False)) | F.coalesce(b.isin(*gone), F.lit(False)), "404/410 gone")
        .when(F.coalesce(a.isin(*blocked) & b.isin(*blocked), F.lit(False)), "403/451 blocked at both L0 and L1")
        .when(unread, "binary decode failure on a PDF").otherwise("")
    )


def file_name(text: Column | str, most: int = 50, fallback: str = "query") -> Column:
    """A text as a file name (U14): illegal characters become `-`, white space one blank, no blank or point at the ends."""
    s = F.regexp_replace(trimmed(text), r'[\\/:*?"<>|\x00-\x1f]', "-")
    s = F.substring(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", ""), 1, most)
    return F.when(s == "", fallback).otherwise(s)
