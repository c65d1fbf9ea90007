"""Fetching books: one request a book, results and failures as columns."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from http.client import HTTPException

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import ids, text

TIMEOUT = 10


def http_get(url: str) -> tuple[int | None, str | None]:
    """Status and text; no status if the server could not be reached."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, None
    except (OSError, HTTPException, ValueError):  # unreachable, cut off in the middle, or no answer in the protocol
        return None, None


class Host:
    """One task's dealings with one host: a kept connection, requests no closer than `gap` seconds, bounded retries.

    A dropped connection is opened anew; no answer, 408, 429 and 5xx are tried again after growing waits (or what
    the answer asks for, if that is no more than LONGEST), `tries` times at most.
    """

    FIRST_WAIT, LONGEST = 0.2, 30.0

    def __init__(self, scheme: str, place: str, gap: float, tries: int):
        self.kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        self.place, self.gap, self.tries = place, gap, tries
        self.connection: http.client.HTTPConnection | None = None
        self.next_at = 0.0

    def _once(self, target: str) -> tuple[int | None, str | None, str | None]:
        time.sleep(max(0.0, self.next_at - time.monotonic()))
        self.next_at = time.monotonic() + self.gap
        try:
            if self.connection is None:
                self.connection = self.kind(self.place, timeout=TIMEOUT)
            self.connection.request("GET", target)
            answer = self.connection.getresponse()
            body = answer.read().decode("utf-8", "replace")
            return answer.status, body if answer.status == 200 else None, answer.headers.get("Retry-After")
        except (OSError, HTTPException, ValueError):
            self.close()
            return None, None, None

    def get(self, target: str) -> tuple[int | None, str | None]:
        wait = self.FIRST_WAIT
        for turn in range(self.tries):
            status, body, asked = self._once(target)
            again = status is None or status in (408, 429) or status >= 500
            if not again or turn == self.tries - 1:
                return status, body
            time.sleep(min(float(asked), self.LONGEST) if asked and asked.isdigit() else wait)
            wait = min(2 * wait, self.LONGEST)
        return None, None

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
            self.connection = None


def fetch_politely(urls: DataFrame, per_second: float = 2.0, lanes: int = 1, tries: int = 3) -> DataFrame:
    """(.., status, text) of urls(source_url, ..): each host is the work of `lanes` tasks, so its limit holds.

    A host gets at most `per_second` requests a second over all its lanes, by one kept connection a lane. Different
    hosts are fetched side by side. A redirect is not followed and counts as its status.
    """
    gap = lanes / per_second
    host = F.regexp_extract("source_url", r"^[a-z]+://([^/?#]*)", 1)
    dealt = urls.withColumn("_host", host).withColumn("_lane", F.pmod(F.xxhash64("source_url"), F.lit(lanes)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = urllib.parse.urlsplit(rows["source_url"].iloc[0])
        with_host = Host(first.scheme, first.netloc, gap, tries)
        got = []
        for url in rows["source_url"]:
            parts = urllib.parse.urlsplit(url)
            got.append(with_host.get(parts.path + (f"?{parts.query}" if parts.query else "") or "/"))
        with_host.close()
        return rows.drop(columns=["_host", "_lane"]).assign(status=pd.array([g[0] for g in got], dtype="Int32"), text=[g[1] for g in got])

    kind = ", ".join(f"{c} {t}" for c, t in urls.dtypes) + ", status int, text string"
    return dealt.groupBy("_host", "_lane").applyInPandas(run, kind)


def fetch(book_ids: DataFrame, get: Callable[[str], tuple[int | None, str | None]] | None = http_get, template: str | None = None) -> DataFrame:
    """(book_id, source_url, outcome, header, body, downloaded_at) of book_ids(book_id).

    outcome is ok, permanent (the answer says so, or the text lacks its markers) or transient. Without `get` a host's
    rate is limited (see fetch_politely).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [get(u) for u in rows["source_url"]]
            yield rows.assign(status=pd.array([g[0] for g in got], dtype="Int32"), text=[g[1] for g in got])

    url = ids.book_url(F.col("book_id"), template) if template else ids.book_url(F.col("book_id"))
    asked = book_ids.select("book_id", url.alias("source_url"))
    got = asked.mapInPandas(run, "book_id long, source_url string, status int, text string") if get else fetch_politely(asked)
    parts = got.withColumn("parts", text.split_markers(F.col("text"))).withColumn("class", ids.status_class(F.col("status")))
    outcome = F.when(F.col("status").isNull(), "transient").when((F.col("class") == "ok") & F.col("parts.failed"), "permanent").otherwise(F.col("class"))
    return parts.select("book_id", "source_url", outcome.alias("outcome"), "parts.header", "parts.body", F.current_timestamp().alias("downloaded_at"))
