"""Crawl policies of documentation sources, and policies read from JSON."""

from __future__ import annotations

import json

from foliospark.functions.urls import CrawlPolicy

_HELPFUL = r"(?i)^was this page helpful\??$"
_ON_PAGE = r"(?i)^on this page$"


def _policy(source_id: str, allow, deny=(), pages=20, depth=2, noise=()) -> CrawlPolicy:
    return CrawlPolicy(source_id, tuple(allow), tuple(deny), pages, depth, tuple(noise))


# Scope, caps and noise lines of the seven known sources.
CRAWL_POLICIES = {
    p.source_id: p
    for p in (
        _policy("openai", ["/api/docs", "/docs"], pages=50, depth=1,
                noise=["(?i)^(search|search docs)$", "(?i)^(copy page|copy link|view all docs)$", _ON_PAGE, _HELPFUL]),
        _policy("nextjs", ["/docs"], ["/docs/messages"], 60, 1,
                [_ON_PAGE, "(?i)^(previous|next)$", "(?i)^edit this page$", "(?i)^supported by vercel$"]),
        _policy("plaid", ["/docs", "/docs/payment-initiation", "/docs/open-banking"], pages=80,
                noise=["(?i)^search or ask a question$", "(?i)^ask bill!?$", "(?i)^all docs$", "(?i)^open nav$",
                       "(?i)^close search modal$", "(?i)^log in$", "(?i)^get api keys$", _HELPFUL,
                       "(?i)^subscribe to updates$", "(?i)^site navigation$"]),
        _policy("stripe", ["/docs", "/api", "/payments", "/webhooks", "/checkout"], pages=100,
                noise=["(?i)^ask ai$", "(?i)^view as markdown$", "(?i)^copy for llm$", _HELPFUL, _ON_PAGE]),
        _policy("react", ["/reference"],
                noise=["(?i)^learn react$", "(?i)^api reference$", "(?i)^community$", "(?i)^blog$", r"(?i)^was this page useful\??$"]),
        _policy("openbanking-uk", ["/read-write-api-specs", "/read-write-api-specs/versions"], pages=40,
                noise=["(?i)^edit this page$", "(?i)^table of contents$", _HELPFUL]),
        _policy("mdn-http", ["/en-US/docs/Web/HTTP"], pages=80,
                noise=["(?i)^related topics$", "(?i)^breadcrumbs$", "(?i)^last modified on"]),
    )
}


def policies_from_json(text: str) -> dict[str, CrawlPolicy]:
    """Policies by source id; of equal ids the last one wins."""
    out = {}
    for p in json.loads(text):
        out[p["source_id"]] = _policy(
            p["source_id"], p.get("allow", ()), p.get("deny", ()), p.get("max_pages", 20), p.get("max_depth", 2), p.get("noise_lines", ())
        )
    return out
