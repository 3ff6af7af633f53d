"""URL and HTML functions: normalisation, crawl filters, titles, text and links of pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.config import MAX_URL

#: Elements without content, tracking parameters, extensions that are not pages, links that are not followed, accepted types.
CHROME = frozenset(("script", "style", "noscript", "nav", "footer", "header", "aside", "form"))
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid",
    "ref", "ref_src", "source", "_ga", "yclid", "dclid",
)
BLOCKED = (
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "tiff", "mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "mp3", "wav", "ogg", "flac",
    "m4a", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "epub", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "css", "js", "json",
    "xml", "rss", "atom", "exe", "dmg", "iso", "bin", "apk", "deb", "rpm", "woff", "woff2", "ttf", "eot",
)
NOT_LINKS = ("javascript:", "mailto:", "tel:", "#")
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
RAW_TEXT = frozenset(("script", "style"))


def normalized(url: str | None) -> str | None:
    """The canonical form of an absolute http(s) URL, or None."""
    try:
        u = urlsplit((url or "").strip())
        host, port = u.hostname, u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not host:
        return None
    scheme = u.scheme.lower()
    shown = host.lower()
    if port and port != {"http": 80, "https": 443}[scheme]:
        shown += f":{port}"
    params = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING)
    return urlunsplit((scheme, shown, u.path or "/", urlencode(params), ""))


@F.pandas_udf(T.StringType())
def normalize_url_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalized)


def normalize_url(url: Column) -> Column:
    """The same for URLs whose query needs no re-encoding, as an expression."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(
        F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING)
    )
    query = F.array_join(F.array_sort(pairs), "&")
    full = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != ""), full)


def is_crawlable(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Not too long, http(s) with a host, no blocked extension, and on an allowed domain if there are any."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)), r":\d*$", "")
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    extension = F.regexp_extract(path, r"\.([^./]*)$", 1)
    ok = (F.length(url) <= MAX_URL) & scheme.isin("http", "https") & (host != "") & ~extension.isin(*BLOCKED)
    for i, domain in enumerate(allowed):
        on = (host == domain) | host.endswith(f".{domain}")
        within = on if i == 0 else within | on  # noqa: F821
    return ok & within if allowed else ok


def host_key(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))


class _Page(HTMLParser):
    """One pass over a page: title candidates, text outside chrome, links in and outside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.titles = {"title": [], "h1": []}
        self.og = ""
        self.text: list[str] = []
        self.links: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta" and attrs.get("property") == "og:title" and not self.og:
            self.og = (attrs.get("content") or "").strip()
        if tag == "a" and attrs.get("href") is not None:
            self.links.append((attrs["href"].strip(), any(t in CHROME for t in self.open)))
        if tag in self.titles and not self.done(tag):
            self.titles[tag].append([])
        if tag not in VOID:
            self.open.append(tag)

    def done(self, tag: str) -> bool:
        return bool(self.titles[tag])

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        for tag, found in self.titles.items():
            if tag in self.open and len(found) == 1:
                found[0].append(data)
        if not any(t in CHROME for t in self.open) and data.strip():
            self.text.append(data.strip())

    def first(self, tag: str) -> str:
        return " ".join("".join(self.titles[tag][0]).split()) if self.titles[tag] else ""


def _slug(url: str) -> str:
    u = urlsplit(url)
    last = u.path.rstrip("/").rsplit("/", 1)[-1].replace("-", " ").replace("_", " ").strip()
    return last or u.netloc


def extract(page: str | None, url: str, scope: str = "content") -> dict:
    """Title (at most 500 characters), body text and links of a page; ``scope="all"`` takes links in chrome too."""
    p = _Page()
    p.feed(page or "")
    p.close()
    links = set()
    for href, in_chrome in p.links:
        if (in_chrome and scope != "all") or not href or href.lower().startswith(NOT_LINKS):
            continue
        try:
            target = normalized(urljoin(url, href))
        except ValueError:
            continue
        if target and target != url and crawlable(target):
            links.add(target)
    title = p.first("title") or p.first("h1") or p.og or _slug(url)
    return {"title": title[:500], "text": " ".join(p.text), "links": sorted(links)}


def crawlable(url: str, allowed: tuple[str, ...] = ()) -> bool:
    u = urlsplit(url)
    extension = u.path.lower().rsplit("/", 1)[-1].rpartition(".")
    host = (u.hostname or "").lower()
    ok = len(url) <= MAX_URL and u.scheme in ("http", "https") and bool(host) and not (extension[1] and extension[2] in BLOCKED)
    return ok and (not allowed or any(host == d or host.endswith(f".{d}") for d in allowed))


def html_extract_udf(scope: str = "content"):
    @F.pandas_udf("title string, text string, links array<string>")
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(p, u, scope) for p, u in zip(pages, urls)], columns=["title", "text", "links"])

    return run


def page_title(html: Column, url: Column) -> Column:
    """The title chain for well-formed pages as an expression: title, h1, og:title, slug."""
    from .analyzers import title_from_url

    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    og = F.trim(F.regexp_extract(html, r'(?is)<meta property="og:title" content="([^"]*)"', 1))
    return F.substring(F.coalesce(*(F.nullif(x, F.lit("")) for x in (inner("title"), inner("h1"), og)), title_from_url(url)), 1, 500)
