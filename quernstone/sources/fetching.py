"""Fetching pages and embedding texts through a transport that the caller gives.

A transport is a function of a URL that returns (status, final url, headers, body) or raises; an
embedder is a function of a list of texts that returns as many vectors. Both run in tasks: URLs are
partitioned by host, so that one task keeps the delay between a site's pages, and texts go in
batches. Nothing here opens a connection by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import url as U

# Statuses that are tried again, attempts, and the waits between an embedder's attempts in seconds.
TRANSIENT = (429, 500, 502, 503, 504)
ATTEMPTS = 3
EMBED_WAITS = (0, 2, 8, 32)

Response = tuple[int, str, dict[str, str], str]
Transport = Callable[[str], Response]
FETCHED = "url string, final_url string, status_code int, html string, headers map<string,string>, render_method string, error string, attempts int"


@dataclass(frozen=True)
class ClientSettings:
    """What a transport should be made with."""

    agent: str = "quernstone"
    timeout: float = 30.0
    redirects: int = 10
    connections: int = 10
    kept_alive: int = 5

    def headers(self) -> dict[str, str]:
        return {"User-Agent": self.agent, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Language": "en"}


def wait_of(header: str | None, attempt: int, base: float, now: float) -> float:
    """Seconds that a Retry-After header asks for, as a number or a date, else base to the attempt."""
    if header:
        try:
            return max(0.0, float(header))
        except ValueError:
            pass
        try:
            return max(0.0, parsedate_to_datetime(header).timestamp() - now)
        except (TypeError, ValueError):
            pass
    return base**attempt


def fetch_one(url: str, transport: Transport, attempts: int = ATTEMPTS, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The last answer for a URL: transient failures are tried again, others are final."""
    row = {"url": url, "final_url": url, "status_code": 0, "html": None, "headers": {}, "render_method": "http", "error": None, "attempts": 0}
    for n in range(1, max(1, attempts) + 1):
        row["attempts"] = n
        wait = base**n
        try:
            status, final, headers, body = transport(url)
            row |= {"status_code": int(status), "final_url": final or url, "headers": dict(headers or {}), "html": body if status == 200 else None, "error": None if status == 200 else f"HTTP {status}"}
            if status not in TRANSIENT:
                break
            wait = wait_of({k.lower(): v for k, v in row["headers"].items()}.get("retry-after"), n, base, time.time())
        except Exception as e:  # a transport's failure is an answer too
            row |= {"status_code": 0, "error": f"{type(e).__name__}: {e}"}
        if n < attempts:
            sleep(wait)
    return row


def fetch_all(urls: DataFrame, transport: Transport, delay: float = 1.0, attempts: int = ATTEMPTS, rendered: Transport | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row for each distinct url of (url[, render]); rows with ``render`` true go through the second transport, if there is one."""
    want = F.col("render") if "render" in urls.columns else F.lit(False)
    rows = urls.where("url is not null").groupBy("url").agg(F.max(F.coalesce(want, F.lit(False))).alias("render")).withColumn("host", U.host(F.col("url")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: str | None = None
        for pdf in batches:
            out = []
            for url, render, host in zip(pdf["url"], pdf["render"], pdf["host"]):
                if host == last:
                    sleep(delay)
                last = host
                browser = bool(render) and rendered is not None
                out.append(fetch_one(url, rendered if browser else transport, attempts, sleep=sleep) | ({"render_method": "browser"} if browser else {}))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")])

    return rows.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, FETCHED)


Embedder = Callable[[list[str]], list[list[float]]]
_embedders: dict[str, tuple[Callable[..., Embedder], int, int]] = {}


class Refused(Exception):
    """An embedder's answer that trying again won't change."""


def register(name: str, factory: Callable[..., Embedder], dims: int, batch: int) -> None:
    _embedders[name] = factory, dims, batch


def embedder(name: str, **options) -> tuple[Embedder, int, int]:
    """A registered embedder with its dimensions and batch size."""
    if name not in _embedders:
        raise ValueError(f"no embedder is called {name}")
    factory, dims, batch = _embedders[name]
    return factory(**options), dims, batch


def embed_batch(texts: list[str], embed: Embedder, waits: tuple[float, ...] = EMBED_WAITS, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of a batch in its order; failures are tried again after growing waits, refusals and wrong counts aren't."""
    for n, wait in enumerate(waits):
        if wait:
            sleep(wait)
        try:
            out = embed(texts)
        except Refused:
            raise
        except Exception:
            if n + 1 == len(waits):
                raise
            continue
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return out
    return []


def embed_rows(rows: DataFrame, text: str, embed: Embedder, batch: int = 128, waits: tuple[float, ...] = EMBED_WAITS) -> DataFrame:
    """``rows`` with a vector; null texts have none."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector"), "vector array<float>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list = [None] * len(pdf)
            some = [i for i, t in enumerate(pdf[text]) if t is not None]
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                for i, v in zip(part, embed_batch([pdf[text].iloc[i] for i in part], embed, waits)):
                    out[i] = v
            yield pdf.assign(vector=out)

    return rows.drop("vector").mapInPandas(run, schema)
