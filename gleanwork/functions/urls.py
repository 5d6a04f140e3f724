"""URL functions as column expressions.

Null gives null unless said otherwise. RFC 3986 parts are taken by pattern, as parse_url drops ports and fails on blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.values import TRACKING

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def _parts(url: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(whether url has a scheme and host part, scheme, authority, path, query without ?), by plain string functions."""
    whole = F.substring_index(url, "#", 1)
    before = F.substring_index(whole, "?", 1)
    query = F.substr(whole, F.length(before) + 2)
    scheme = F.substring_index(before, "://", 1)
    rest = F.substr(before, F.length(scheme) + 4)
    authority = F.substring_index(rest, "/", 1)
    return url.rlike(_ABSOLUTE), scheme, authority, F.substr(rest, F.length(authority) + 1), query


def _coded(part: Column) -> Column:
    """A name or value of a query, decoded and encoded again, so that equal ones are spelt alike; null if it can't be decoded."""
    return F.replace(F.replace(F.url_encode(F.try_url_decode(part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column) -> Column:
    """The key by which urls of one page agree.

    Scheme and host in lower case, host without a leading www., no fragment, no tracking parameters, the others decoded,
    sorted by name (values of one name keep their order) and encoded again, no closing slashes unless the path is just
    /. A pair that can't be decoded is left out, a bare ? stays. A url whose path can't be decoded is put in lower
    case without closing slashes.
    """
    absolute, scheme, authority, path, query = _parts(url)
    relative = F.startswith(url, F.lit("//"))
    whole = F.substring_index(url, "#", 1)
    before = F.substring_index(whole, "?", 1)
    rest = F.substring(before, 3, 1 << 20)
    authority = F.when(absolute, authority).when(relative, F.substring_index(rest, "/", 1)).otherwise(F.lit(""))
    path = F.when(absolute, path).when(relative, F.substr(rest, F.length(authority) + 1)).otherwise(before)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    name = lambda p: F.substring_index(p, "=", 1)
    named = F.transform(pairs, lambda p, i: F.struct(F.try_url_decode(name(p)).alias("n"), i.alias("i"), _coded(F.substr(p, F.length(name(p)) + 2)).alias("v")))
    kept = F.filter(named, lambda s: s["n"].isNotNull() & s["v"].isNotNull() & ~F.lower(s["n"]).isin(TRACKING))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(_coded(F.url_encode(s["n"])), F.lit("="), s["v"])), "&")
    bare = F.when(F.contains(whole, F.lit("?")) & (query == ""), F.lit("?")).when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))
    path = F.when(F.length(path) <= 1, path).otherwise(F.rtrim(path, F.lit("/")))
    host = F.regexp_replace(F.lower(authority), r"^www\.", "")
    start = F.when(absolute, F.concat(F.lower(scheme), F.lit("://"))).when(relative, F.lit("//")).otherwise(F.lit(""))
    broken = F.contains(F.regexp_replace(before, "%[0-9A-Fa-f]{2}", ""), F.lit("%")) | F.startswith(url, F.lit(":"))
    return F.when(broken, F.rtrim(F.lower(url), F.lit("/"))).otherwise(F.concat(start, host, path, bare))


def url_authority(url: Column) -> Column:
    """Host and port in lower case as they stand in the url; empty if there are none."""
    absolute, _, authority, _, _ = _parts(url)
    return F.when(absolute, F.lower(authority)).otherwise(F.when(url.isNotNull(), F.lit("")))


def url_domain(url: Column) -> Column:
    """Host without a leading www.; a url without a host unchanged."""
    absolute, _, authority, _, _ = _parts(url)
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"^www\.", "")
    return F.when(absolute & (host != ""), host).otherwise(url)


def domain_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: what turns a match on domain endings into an equality join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_score(host: Column, scores: dict[str, float], default: float, docs: float) -> Column:
    """The score of the longest domain of scores that host is or ends with, else docs for a host docs.*, else default.

    scores is a configured list, held in the expression, so nothing is joined or shuffled.
    """
    table = F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*map(F.lit, scores.values()))) if scores else None
    found = F.get(F.filter(F.transform(domain_suffixes(host), lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull()), F.lit(0)) if scores else F.lit(None).cast("double")
    return F.coalesce(found, F.when(F.startswith(host, F.lit("docs.")), F.lit(docs)), F.lit(default))


def ends_with_domain(domain: Column, pattern: Column) -> Column:
    """Whether domain is pattern or a subdomain of it, without case; false for an empty one."""
    d, p = F.lower(domain), F.lower(pattern)
    return (d != "") & (p != "") & ((d == p) | F.endswith(d, F.concat(F.lit("."), p)))


def unwrap_redirect(href: Column, parameter: str = "uddg") -> Column:
    """The target that a redirect link carries in a parameter; // is taken as https."""
    absolute = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    target = F.regexp_extract(absolute, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(absolute)


def raw_snapshot_url(url: Column) -> Column:
    """The url of an archived page without the archive's own frame; one that has the mark already is left as it is."""
    return F.when(url.rlike(r"/web/\d+id_/"), url).otherwise(F.regexp_replace(url, r"/web/(\d+)/", "/web/$1id_/"))


def redirected(base: Column, location: Column) -> Column:
    """Where a redirect from base leads: location itself, or resolved against base if it lacks scheme or host; null without one."""
    absolute, scheme, authority, path, _ = _parts(base)
    folder = F.regexp_replace(path, "[^/]*$", "")
    site = F.concat(scheme, F.lit("://"), authority)
    joined = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), location)
    return (
        F.when(F.coalesce(location, F.lit("")) == "", F.lit(None).cast("string")).when(location.rlike(_ABSOLUTE), location).when(~absolute, location)
        .when(F.startswith(location, F.lit("//")), F.concat(scheme, F.lit(":"), location)).when(F.startswith(location, F.lit("/")), F.concat(site, location))
        .when(F.startswith(location, F.lit("?")), F.concat(site, path, location)).otherwise(F.concat(site, joined))
    )
