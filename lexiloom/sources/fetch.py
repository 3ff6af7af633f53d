"""Fetching and robots rules over URL tables, with the network as a function passed in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from urllib.robotparser import RobotFileParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.config import CRAWL_DELAY_S
from lexiloom.functions.web import CONTENT_TYPES
from lexiloom.schemas import FETCHED

#: Statuses that are tried again, how often, the first wait in seconds (it doubles), and the most that is read of a page.
RETRIED, RETRIES, BACKOFF_S, PAGE_CAP = (429, 500, 502, 503, 504), 3, 0.5, 5 << 20


def read_body(body: bytes | Iterable[bytes], cap: int = PAGE_CAP) -> bytes | None:
    """A body given whole or in parts; None as soon as it is larger than the cap."""
    parts, size = [], 0
    for part in (body,) if isinstance(body, bytes) else body:
        size += len(part)
        if size > cap:
            return None
        parts.append(part)
    return b"".join(parts)


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes | Iterable[bytes], str]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows of ``FETCHED`` for pages of status 200, an accepted type and at most 5 MB.

    ``get(url)``: status, content type, body (whole, or parts as they come) and final URL; called again on passing
    failures, after waits that double.  The body is read after status and type are known, and no further than the cap."""

    def run(batches):
        for b in batches:
            rows = []
            for url in b["url"]:
                for k in range(1 + RETRIES):
                    if k:
                        wait(BACKOFF_S * 2 ** (k - 1))
                    status, kind, body, final = get(url)
                    if status not in RETRIED:
                        break
                if status == 200 and kind.split(";")[0].strip().lower() in CONTENT_TYPES and (data := read_body(body)) is not None:
                    rows.append((url, data.decode("utf-8", "replace"), status, final, len(data)))
            yield pd.DataFrame(rows, columns=["url", "html", "status_code", "final_url", "content_length"])

    return urls.select("url").mapInPandas(run, FETCHED)


def robots_verdicts(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``url, allowed, delay``: by the host's rules (``host, body``); no rules allow all, no host allows nothing."""

    @F.pandas_udf("allowed boolean, delay double")
    def judge(url: pd.Series, body: pd.Series) -> pd.DataFrame:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for u, text in zip(url, body):
            if not urlsplit(u or "").netloc:
                out.append((False, CRAWL_DELAY_S))
                continue
            if text is None:
                out.append((True, CRAWL_DELAY_S))
                continue
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            rules = parsed[text]
            out.append((rules.can_fetch(agent, u), max(float(rules.crawl_delay(agent) or 0), CRAWL_DELAY_S)))
        return pd.DataFrame(out, columns=["allowed", "delay"])

    keyed = urls.withColumn("host", F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)))
    return keyed.join(robots.select("host", "body"), "host", "left").withColumn("v", judge("url", "body")).select("url", "v.allowed", "v.delay")
