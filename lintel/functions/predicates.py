"""Tests of HTML bodies and receipts, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions.text import squeeze
from lintel.functions.urls import dialog_provider

# The patterns that decide.
COMPLETE = r"(?is)<html[\s>].*</html>"
SCRIPT = r"(?is)<script[^>]*>.*?</script>|<script[^>]*/>|javascript:"
RENDERED = r"""(?i)__NEXT_DATA__|self\.__next_f|/_next/static|id=["']__(?:next|nuxt)["']|id=["']root["']|window\.__NUXT__|ng-version=|/@vite/client"""
CAPTCHA = r"(?i)captcha|unusual traffic|are you a robot|verify you(?:'|&#39;)?re a human|/sorry/index|automated queries"
LOGIN = r"(?i)log in|sign in|login required|authentication required"
GONE = r"(?i)deleted|expired|not found|unavailable"
ENQUEUE = "window.__reactRouterContext.streamController.enqueue("


def is_complete_html(html: Column) -> Column:
    return F.regexp_like(html, F.lit(COMPLETE))


def has_script(html: Column) -> Column:
    return F.regexp_like(html, F.lit(SCRIPT))


def has_client_markers(html: Column) -> Column:
    return F.regexp_like(html, F.lit(RENDERED))


def static_text_length(html: Column) -> Column:
    """Length of the body's text without scripts, styles and templates; tags stripped by pattern, entities counted as written."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head>", "")
    return F.length(squeeze(F.regexp_replace(bare, r"<[^>]*>", "")))


def should_render(html: Column, least: int = 200) -> Column:
    return ~is_complete_html(html) | (has_client_markers(html) & (static_text_length(html) < least))


def html_route_renders(html: Column) -> Column:
    return ~is_complete_html(html) | has_script(html)


def is_captcha(html: Column) -> Column:
    return F.coalesce(F.regexp_like(html, F.lit(CAPTCHA)), F.lit(False))


def is_interstitial(body: Column) -> Column:
    has = lambda what: F.contains(body, F.lit(what))
    return (
        has("share.google/aimode")
        | (has("Google Search") & has("If you're having trouble accessing Google Search"))
        | (has("/search?q=") & has("enablejs"))
        | (has("/httpservice/retry/enablejs") & has("Google Search"))
    )


def unsupported_reason(body: Column, provider: Column) -> Column:
    """The first reason that holds; the order matters."""
    return (
        F.when(is_interstitial(body), "provider_challenge_interstitial")
        .when(F.regexp_like(body, F.lit(LOGIN)), "login_required")
        .when(F.regexp_like(body, F.lit(GONE)), "deleted_or_expired_share")
        .when(provider == "unknown", "unsupported_provider_format")
        .otherwise("no_transcript_in_captured_dom")
    )


def detected_provider(body: Column, url: Column) -> Column:
    chat = F.contains(body, F.lit(ENQUEUE)) | F.contains(body, F.lit("linear_conversation"))
    return F.coalesce(dialog_provider(url), F.when(chat, "chatgpt").when(is_interstitial(body), "google_ai_mode").otherwise("unknown"))


def has_base64_image(markdown: Column) -> Column:
    return F.regexp_like(markdown, F.lit(r"!\[[^\]]*\]\(data:image/[^;]+;base64,"))


def declared_charset(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?i)<meta[^>]+charset=["']?([^"'>\s]+)""", 1))


def with_utf8_charset(html: Column) -> Column:
    """The declared charset replaced by utf-8, or a declaration put at the head's start."""
    declared = F.regexp_like(html, F.lit(r"""(?i)<meta[^>]+charset=["']?[^"'>\s]+"""))
    replaced = F.regexp_replace(html, r"""(?i)(<meta[^>]+charset=["']?)[^"'>\s]+""", "$1utf-8")
    headed = F.regexp_replace(html, r"(?i)(<head[^>]*>)", '$1<meta charset="utf-8">')
    return F.when(declared, replaced).otherwise(headed)


# ---- receipts ---------------------------------------------------------------------------

#: The headers that a receipt keeps, and those that end at a proxy.
RECEIPT_HEADERS = ["cache-control", "content-length", "content-type", "date", "etag", "last-modified", "location"]
HOP_BY_HOP = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def receipt_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(RECEIPT_HEADERS) & v.isNotNull())


def proxy_headers(headers: Column, keep_length: bool = False) -> Column:
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    named = F.transform(F.split(F.coalesce(F.element_at(low, "connection"), F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    encoded = F.coalesce(F.element_at(low, "content-encoding"), F.lit("")) != ""
    length_goes = F.lit(True) if not keep_length else encoded

    def kept(k: Column, v: Column) -> Column:
        name = F.lower(k)
        return ~name.isin([*HOP_BY_HOP, "content-encoding"]) & ~F.array_contains(named, name) & ~((name == "content-length") & length_goes)

    return F.map_filter(headers, kept)


def error_kind(name: Column, aborted: Column | None = None) -> Column:
    gone = F.coalesce(aborted, F.lit(False)) if aborted is not None else F.lit(False)
    return F.when(name.isNull() & ~gone, F.lit(None).cast("string")).when(gone | (name == "AbortError"), "cancelled").when(name.isin("TimeoutError", "request-timeout"), "timeout").when(name == "TypeError", "cors_or_transport").otherwise("transport")


def image_quality(q: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(q, F.lit(80))))
