"""URL columns: canonical form, crawl scope, links and sitemaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.idn import ascii_host
from foliospark.functions.lexicon import IGNORED_EXTENSIONS
from foliospark.functions.text import sub, trim_ws

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
_DROPPED = r"(?:utm_[^=&]*|ref|source)(?:=[^&]*)?"


@dataclass(frozen=True)
class CrawlPolicy:
    """Scope, caps and noise patterns of a source's crawl."""

    source_id: str
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    max_pages: int = 20
    max_depth: int = 2
    noise_lines: tuple[str, ...] = ()
    user_agent: str = "foliospark"


#: Characters that a path and a query may not hold as such.
_IN_PATH, _IN_QUERY = r"[^!-~]|[\"<>^`{}]", r"[^!-~]|[\"<>']"


def percent_encoded(text: Column, pattern: str) -> Column:
    """A text whose characters that match the pattern are percent-encoded; others, % too, stay."""
    one = lambda c: F.when(c.rlike(pattern), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, "", -1), one), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments, written plainly or encoded, are resolved; above the root there is nothing."""
    one, two = r"^(?i:\.|%2e)$", r"^(?i:(\.|%2e){2})$"
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    none = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(x.rlike(one), kept).when(x.rlike(two), up).otherwise(F.concat(kept, F.array(x)))

    last = F.element_at(parts, -1)
    end = F.when(last.rlike(one) | last.rlike(two), F.array(F.lit(""))).otherwise(none)
    joined = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, none, step), end), "/"))
    return F.when(path.rlike(r"/(?i:\.|%2e){1,2}(/|$)"), joined).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, the host in ASCII, default port, fragment, tracking keys and one trailing slash removed, dot
    segments resolved, path and query encoded.

    Null for what is not an absolute URL.
    """
    part = lambda k: F.regexp_extract(url, _URL, k)
    scheme = F.lower(part(1))
    host = F.lower(part(2))
    host = F.when(scheme == "http", sub(host, r":80$", "")).when(scheme == "https", sub(host, r":443$", "")).otherwise(host)
    host = ascii_host(host)
    path = F.when(part(3) == "", F.lit("/")).otherwise(without_dots(percent_encoded(part(3), _IN_PATH)))
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    pairs = F.filter(F.split(F.substring(part(4), F.lit(2), F.length(part(4))), "&", -1), lambda p: (p != "") & ~p.rlike(f"^{_DROPPED}$"))
    query = percent_encoded(F.array_join(pairs, "&"), _IN_QUERY)
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_URL), whole)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    part = lambda k: F.regexp_extract(url, _URL, k)
    return F.lower(part(1)), F.lower(part(2)), F.when(part(3) == "", F.lit("/")).otherwise(part(3))


def in_scope(url: Column, base: Column, policy: CrawlPolicy | None = None) -> Column:
    """Whether a crawl of ``base`` may follow the URL.

    Prefixes have no segment limit, as crawls always worked: /docs also admits /docsets.
    """
    scheme, host, path = _parts(url)
    _, base_host, base_path = _parts(base)
    root = sub(base_path, "/$", "")
    ok = url.rlike(_URL) & base.rlike(_URL) & scheme.isin("http", "https") & (host == base_host)
    ok = ok & ((root == "") | path.startswith(root))
    if policy and policy.allow:
        ok = ok & _any([path.startswith(p) for p in policy.allow])
    if policy and policy.deny:
        ok = ok & ~_any([path.startswith(p) for p in policy.deny])
    return F.coalesce(ok & ~F.lower(path).rlike(rf"\.(?:{'|'.join(IGNORED_EXTENSIONS)})$"), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def resolve(href: Column, page: Column) -> Column:
    """Absolute form of a link on a page: absolute, scheme-relative, rooted, query, fragment or relative."""
    scheme, host, path = _parts(page)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = F.concat(root, folder, href)
    for _ in range(4):  # dot segments
        joined = sub(sub(joined, r"/\./", "/"), r"(://[^/]+(?:/[^/]+)*?)/(?!\.\./)[^/]+/\.\./", "$1/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(root, path))
        .otherwise(joined)
    )


def page_links(html: Column, page: Column) -> Column:
    """Distinct canonical links, first seen first; mail and script links are skipped."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1)), trim_ws)
    hrefs = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("mailto:") & ~h.startswith("javascript:"))
    return F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: canonical_url(resolve(h, page)))))


def sitemap_urls(xml: Column, base: Column, policy: CrawlPolicy | None = None) -> Column:
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>([^\n]*?)</loc>"), F.lit(1)), lambda u: canonical_url(trim_ws(u)))
    return F.filter(F.array_compact(found), lambda u: in_scope(u, base, policy))


def candidate_seeds(seeds: Column, base: Column) -> Column:
    chosen = F.when(F.size(F.coalesce(seeds, F.array().cast("array<string>"))) > 0, seeds).otherwise(F.array(base))
    return F.array_distinct(F.transform(chosen, canonical_url))
