"""Files and listings from elsewhere: whole or not at all, tried again where that can help.

What speaks to the network is passed in, so that nothing here depends on a
provider: ``fetch(url)`` yields chunks of bytes or raises ``Refused`` with a
status, ``page(number)`` gives the entries of a listing's page.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Refused(Exception):
    """The other side's answer to a request, by its status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


def download(fetch: Callable[[str], Iterable[bytes]], url: str, destination: str, retries: int = 3, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Write what ``url`` gives to ``destination``; its size.

    The file appears under its name when it is whole. A request that the other
    side refuses as wrong (400 to 499) is not repeated; other failures are,
    after ``wait`` seconds the first time, twice that the second, and so on.
    """
    part = f"{destination}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    for attempt in range(1, retries + 1):
        try:
            size = 0
            with open(part, "wb") as out:
                for chunk in fetch(url):
                    out.write(chunk)
                    size += len(chunk)
            os.replace(part, destination)
            return size
        except Exception as error:
            if os.path.exists(part):
                os.remove(part)
            final = isinstance(error, Refused) and 400 <= error.status < 500
            if final or attempt == retries:
                raise
            sleep(wait * attempt)
    raise ValueError("retries must be positive")


def listing(spark: SparkSession, page: Callable[[int], list[tuple[str, int]]], most_pages: int = 100_000) -> DataFrame:
    """path, size of all entries of a paged listing, which ends with an empty page; entries listed twice count once, the last size."""
    rows: dict[str, int] = {}
    for number in range(most_pages):
        entries = page(number)
        if not entries:
            return spark.createDataFrame(list(rows.items()), "path string, size long")
        rows.update(entries)
    raise ValueError(f"the listing has more than {most_pages} pages")
