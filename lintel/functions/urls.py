"""URL predicates and builders as native column expressions."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def part(url: Column, what: str, key: str | None = None) -> Column:
    return F.try_parse_url(url, F.lit(what), F.lit(key)) if key else F.try_parse_url(url, F.lit(what))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern doesn't match."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def ensure_absolute(url: Column) -> Column:
    return F.when(F.regexp_like(url, F.lit(r"(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), url))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def resolve_root_relative(ref: Column, base: Column) -> Column:
    """Origin and percent-encoded path for a reference that begins with one slash; else null."""
    encoded = F.replace(F.url_encode(ref), F.lit("+"), F.lit("%20"))
    for ch in "/,'!()*:@&=+$;~?#%":  # % last: %3F of the reference itself stays
        encoded = F.replace(encoded, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.when(F.regexp_like(ref, F.lit("^/(?!/)")), F.concat(origin(base), encoded))


def resolved(ref: str | None, base: str | None) -> str | None:
    """An absolute URL in WHATWG manner; what can't be resolved comes back as it is."""
    if not ref or not base or ref.lower().startswith(("data:", "blob:", "javascript:")):
        return ref
    try:
        joined = urlsplit(urljoin(base, ref.strip()))
        netloc = joined.netloc.lower()
        safe = "!$&'()*+,;=:@/%~"
        return urlunsplit((joined.scheme.lower(), netloc, quote(joined.path or ("/" if netloc else ""), safe=safe + "[]|^"), quote(joined.query, safe=safe + "?/[]{}|^`"), quote(joined.fragment, safe=safe + "?/[]{}|^")))
    except ValueError:
        return ref


def resolve(ref: Column, base: Column) -> Column:
    def run(r: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resolved(x, y) for x, y in zip(r, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(ref, base)


# ---- file hosts -----------------------------------------------------------------------

_ID = r"^[A-Za-z0-9_-]+$"


def drive_file_id(url: Column) -> Column:
    h, p, q = host(url), path(url), part(url, "QUERY", "id")
    plain = F.when(h == "drive.google.com", F.coalesce(found(p, r"^/file/d/([^/]+)"), F.when(p.isin("/open", "/uc"), q)))
    download = F.when((h == "drive.usercontent.google.com") & (p == "/download"), q)
    got = F.coalesce(plain, download)
    return F.when(F.regexp_like(got, F.lit(_ID)), got)


def drive_download_url(url: Column) -> Column:
    return F.concat(F.lit("https://drive.usercontent.google.com/download?id="), drive_file_id(url), F.lit("&export=view&authuser=0"))


def drive_page_html(url: Column) -> Column:
    src = drive_download_url(url)
    return F.concat(F.lit('<!doctype html><html><body><img src="'), src, F.lit('" alt="Drive image '), drive_file_id(url), F.lit('"></body></html>'))


#: Image content types and their extensions.
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/avif": "avif", "image/bmp": "bmp"}


def content_type(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(value, F.lit("")), r"^([^;]*)", 1)))


def is_image_type(value: Column) -> Column:
    return F.startswith(content_type(value), F.lit("image/"))


def image_type_extension(value: Column) -> Column:
    out = F.lit("bin")
    for kind, ext in IMAGE_TYPES.items():
        out = F.when(content_type(value) == kind, F.lit(ext)).otherwise(out)
    return out


# ---- pages of known kinds ---------------------------------------------------------------


# The hosts of questions, their print view, text pastes, and shared dialogs, here and below.
def question_id(url: Column) -> Column:
    return F.when(bare_host(url) == "stackoverflow.com", found(path(url), r"^/questions/(\d+)(?:/|$)"))


def question_print_url(url: Column) -> Column:
    return F.concat(F.lit("https://www.stackprinter.com/export?question="), question_id(url), F.lit("&format=HTML&language=en&printer=false&service=stackoverflow&width=640"))


def is_transient_error(html: Column) -> Column:
    return F.regexp_like(html, F.lit(r"(?i)Ooooops|Please try again later"))


_PASTE = r"^/(?:(?:en|ru)/)?p/([A-Za-z0-9_-]+)(/raw)?/?$"


def paste_id(url: Column) -> Column:
    return F.when(bare_host(url) == "xpaste.pro", found(path(url), _PASTE))


def paste_page_url(url: Column) -> Column:
    return F.concat(F.lit("https://xpaste.pro/p/"), paste_id(url))


def paste_raw_url(url: Column) -> Column:
    return F.concat(paste_page_url(url), F.lit("/raw"))


def paste_file_name(url: Column) -> Column:
    return F.concat(F.lit("xpaste-"), paste_id(url), F.lit(".txt"))


def text_file_name(url: Column) -> Column:
    """host and path joined with hyphens, as a ``.txt`` name."""
    plain = F.regexp_replace(F.concat_ws("-", bare_host(url), F.regexp_replace(path(url), r"^/+|/+$", "")), r"[^A-Za-z0-9._-]+", "-")
    plain = F.regexp_replace(plain, r"-+$", "")
    return F.when(F.endswith(plain, F.lit(".txt")), plain).otherwise(F.concat(plain, F.lit(".txt")))


def repository(url: Column) -> Column:
    """owner/name for a repository's front page, else null."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.when((bare_host(url) == "github.com") & (F.size(parts) == 2), F.concat(parts[0], F.lit("/"), F.regexp_replace(parts[1], r"\.git$", "")))


_DOC = r"^https?://docs\.google\.com/document/d/([A-Za-z0-9_-]+)"


def is_document_url(url: Column) -> Column:
    return F.regexp_like(url, F.lit(_DOC))


def document_id(url: Column) -> Column:
    return found(url, _DOC)


def document_export_url(doc: Column, fmt: Column | str) -> Column:
    return F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/export?format="), _lit(fmt))


def document_edit_url(doc: Column) -> Column:
    return F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/edit"))


def document_api_url(doc: Column) -> Column:
    return F.concat(F.lit("https://docs.googleapis.com/v1/documents/"), doc)


def capture_method(capture: Column, token: Column) -> Column:
    """How to capture a document; null for an unknown choice, so that a bad row doesn't end the job."""
    return F.when(capture == "browser", "browser-model").when((capture == "api") & (F.coalesce(token, F.lit("")) != ""), "docs-api").when(capture == "api", "public-export")


def image_extension(url: Column, keep_jpeg: bool = False) -> Column:
    """From the path only; ``.png`` where there is none. Variants differ in whether jpeg becomes jpg."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z]+)$", 1))
    known = F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), ext).otherwise("png")
    return F.concat(F.lit("."), known if keep_jpeg else F.when(known == "jpeg", "jpg").otherwise(known))


def mime_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for e, m in {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "md": "text/markdown", "html": "text/html", "txt": "text/plain"}.items():
        out = F.when(ext == e, F.lit(m)).otherwise(out)
    return out


# ---- search and shared dialogs ----------------------------------------------------------


def encode_component(c: Column) -> Column:
    """As encodeURIComponent does."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in "!'()~":
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


#: providers' addresses; ``{q}`` the query, ``{k}`` the limit.
PROVIDERS = {
    "wikipedia": "https://en.wikipedia.org/w/rest.php/v1/search/page?q={q}&limit={k}",
    "duckduckgo": "https://html.duckduckgo.com/html/?q={q}",
    "google": "https://www.google.com/search?q={q}&num={k}",
    "bing": "https://www.bing.com/search?q={q}&count={k}",
    "brave": "https://search.brave.com/search?q={q}",
}


def search_url(provider: Column, query: Column, limit: Column | int = 10) -> Column:
    """Null for an unknown provider."""
    out = F.lit(None).cast("string")
    for name, shape in PROVIDERS.items():
        before, after = shape.split("{q}")
        tail = F.concat(F.lit(after.split("{k}")[0]), _lit(limit).cast("string")) if "{k}" in after else F.lit(after)
        out = F.when(provider == name, F.concat(F.lit(before), encode_component(query), tail)).otherwise(out)
    return out


def redirect_target(href: Column) -> Column:
    """The ``uddg`` parameter of a redirect link, decoded; else the link, with a scheme."""
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    to = F.try_url_decode(found(full, r"[?&]uddg=([^&#]+)"))
    rooted = F.when(F.startswith(full, F.lit("/")), F.concat(F.lit("https://duckduckgo.com"), full)).otherwise(full)
    return F.coalesce(to, rooted, F.lit(""))


def unwrapped(href: Column) -> Column:
    """The target of ``google.com/url?q=``; else the link."""
    return F.coalesce(F.when(bare_host(href) == "google.com", F.when(path(href) == "/url", F.try_url_decode(found(href, r"[?&]q=([^&#]+)")))), href)


def dialog_provider(url: Column) -> Column:
    h = host(url)
    chat = (h == "chatgpt.com") | F.endswith(h, F.lit(".chatgpt.com"))
    return F.when(chat, "chatgpt").when((h == "share.google") & F.startswith(path(url), F.lit("/aimode/")), "google_ai_mode")


def share_id(url: Column) -> Column:
    return found(path(url), r"/share/([^/]+)")


def browser_engine(asked: Column, env: Column | str | None = None) -> Column:
    """Aliases of two engines; the query wins over the environment, puppeteer is the default."""
    name = F.lower(F.coalesce(asked, _lit(env) if env is not None else F.lit(None).cast("string"), F.lit("puppeteer")))
    return F.when(name.isin("playwright", "pw"), "playwright").when(name.isin("puppeteer", "pptr"), "puppeteer").otherwise("puppeteer")


def output_path(data_dir: str, url: Column, ext: Column | str) -> Column:
    """data_dir/host/path/document.ext"""
    parts = F.array_join(F.filter(F.split(path(url), "/"), lambda x: x != ""), "/")
    return F.concat_ws("/", F.lit(data_dir), host(url), F.when(parts != "", parts), F.concat(F.lit("document."), _lit(ext)))


def archive_extension(fmt: Column) -> Column:
    return F.when(fmt == "7z", ".7z").when(fmt.isin("tar.gz", "gz"), ".tar.gz").when(fmt == "tar", ".tar").otherwise(".zip")
