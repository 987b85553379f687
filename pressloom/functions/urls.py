"""URL functions on plain expressions; unparsable URLs never raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions.text import let

SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, SHAPE, i)


def is_url(url: Column) -> Column:
    return url.rlike(SHAPE) & (part(url, 2) != "")


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return F.lower(part(url, 2))


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and leading www.."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""), r"^www\.", "")


def path(url: Column) -> Column:
    return part(url, 3)


def _query(url: Column, drop: str, ordered: bool) -> Column:
    kept = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~p.rlike(drop))
    return F.array_join(F.array_sort(kept) if ordered else kept, "&")


def _rebuilt(url: Column, query: Column) -> Column:
    base = F.concat(scheme(url), F.lit("://"), authority(url), F.when(path(url) == "", "/").otherwise(path(url)))
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_event_url(url: Column) -> Column:
    """No fragment, no tracking parameters, sorted parameters, one trailing slash stripped."""
    out = _rebuilt(url, _query(url, r"^(utm_[^=]*|fbclid|gclid)(=|$)", True))
    return F.when(is_url(url), F.regexp_replace(out, "/$", "")).otherwise(url)


def canonical_candidate_url(url: Column) -> Column:
    """No fragment, no tracking parameters; order and slashes stay."""
    return F.when(is_url(url), _rebuilt(url, _query(url, r"^(utm_[^=]*|spm|from|source|ref)(=|$)", False))).otherwise(url)


def candidate_key(source_id: Column, url: Column) -> Column:
    """Key of a candidate: its source and canonical URL."""
    return F.concat_ws("\n", source_id, canonical_candidate_url(url))


def is_secure_source_url(url: Column) -> Column:
    """https, no credentials, standard port."""
    return is_url(url) & (scheme(url) == "https") & ~F.contains(authority(url), F.lit("@")) & ~authority(url).rlike(r":(?!443$)\d+$")


def is_navigation(url: Column) -> Column:
    """No path segment, or a single one of the navigation vocabulary."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return (F.size(segments) == 0) | ((F.size(segments) == 1) & F.coalesce(F.get(segments, F.lit(0)), F.lit("")).rlike("(?i)" + C.NAVIGATION))


def date_in_path(url: Column) -> Column:
    """The calendar date a URL names, as UTC midnight at +08:00, null if none or impossible."""
    from pressloom.functions.dates import date_in_url

    return F.when(is_url(url), date_in_url(url, path(url)))


def likely_article(url: Column) -> Column:
    """Whether the path looks like an article's."""
    low = F.lower(path(url))
    return reduce(lambda a, p: a | low.rlike(p), C.ARTICLE_PATHS, F.lit(False))


def _escaped(text: Column, signs: str) -> Column:
    """text with signs, controls and everything beyond ASCII as percent escapes of their UTF-8 bytes."""
    bad = rf"[\x00-\x20\x7F-\x{{10FFFF}}{signs}]"
    pieces = lambda c: F.regexp_extract_all(c, F.lit(rf"({bad}|[^\x00-\x20\x7F-\x{{10FFFF}}{signs}]+)"), 1)
    escape = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
    return let(text, lambda c: F.when(c.rlike(bad), F.array_join(F.transform(pieces(c), lambda p: F.when(p.rlike(f"^{bad}$"), escape(p)).otherwise(p)), "")).otherwise(c))


def _without_dots(path: Column) -> Column:
    """An absolute path without its dot segments (RFC 3986, 5.2.4): a fold over the segments."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)
    dot, up = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))
    shorter = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    step = lambda a, s: F.when(up(s), shorter(a)).when(dot(s), a).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when((dot(last) | up(last)) & (F.size(k) > 0), "/").otherwise("")))


def resolve(reference: Column, base: Column) -> Column:
    """The absolute URL that a trimmed reference names on a page at base, blank if none.

    References as RFC 3986 resolves them, with what web addresses add: backslashes count as
    slashes, tabs and line ends go, host and scheme are lower-cased, default ports go, and
    signs that paths and queries cannot hold are escaped.  Schemes other than http and https
    come out as they are; script, mail and telephone links, and references without a usable
    base, are blank.
    """
    return let(F.struct(F.regexp_replace(reference, "[\\t\\n\\r]", "").alias("ref"), base.alias("base")), lambda x: _resolved(x["ref"], x["base"]))


def _resolved(ref: Column, base: Column) -> Column:
    own, rest = F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_replace(ref, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    web = F.lower(own).isin("http", "https")
    same = web & (F.lower(own) == scheme(base)) & ~rest.rlike(r"^[/\\]")  # http:x on an http page is relative
    tail = F.when((own == "") | same, rest).otherwise(F.regexp_replace(rest, r"^[/\\]*", "//"))
    frag = F.when(F.contains(tail, F.lit("#")), F.concat(F.lit("#"), _escaped(F.regexp_extract(tail, "(?s)#(.*)$", 1), '"<>`'))).otherwise("")
    body = F.regexp_replace(tail, "(?s)#.*$", "")
    asked = F.when(F.contains(body, F.lit("?")), F.concat(F.lit("?"), _escaped(F.regexp_extract(body, r"(?s)\?(.*)$", 1), "\"<>'"))).otherwise("")
    way = F.translate(F.regexp_replace(body, r"(?s)\?.*$", ""), "\\", "/")
    named = F.startswith(way, F.lit("//"))
    own_place = F.regexp_extract(way, "^//([^/]*)", 1)
    place = F.when(named, own_place).otherwise(part(base, 2))
    kind = F.when((own == "") | same, scheme(base)).otherwise(F.lower(own))
    port = F.when(kind == "https", ":443").otherwise(":80")
    user, server = F.regexp_extract(place, "^(.*@)", 1), F.lower(F.regexp_replace(place, "^.*@", ""))
    server = F.when(F.endswith(server, port), F.substring(server, F.lit(1), F.length(server) - F.length(port))).otherwise(server)
    server = F.regexp_replace(server, ":$", "")
    old = F.when(path(base) == "", "/").otherwise(path(base))
    at = F.when(named, F.regexp_replace(way, "^//[^/]*", "")).when(F.startswith(way, F.lit("/")), way).when(way == "", old).otherwise(F.concat(F.regexp_extract(old, "(?s)^(.*/)", 1), way))
    at = _without_dots(F.when(at == "", "/").otherwise(at))
    old_query = F.when(F.contains(F.regexp_replace(base, "(?s)#.*$", ""), F.lit("?")), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    query = F.when((asked == "") & (way == "") & ~named, old_query).otherwise(asked)
    made = F.concat(kind, F.lit("://"), user, server, _escaped(at, '"<>`{}^'), query, frag)
    usable = (server != "") & ~server.rlike(r"[\s<>^|%]") & is_url(base)
    return F.when((ref == "") | ref.rlike(C.NO_LINKS), "").when((own != "") & ~web, ref).otherwise(F.when(usable, made).otherwise(""))
