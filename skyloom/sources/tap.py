"""A client of TAP services: page by page, with a bounded wait and retries."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from skyloom.sources import fits
from skyloom.sources.tables import retry


def adql(columns: list[str], table: str, top: int | None = None, where: list[str] = (), order: str | None = None) -> str:
    first = f"SELECT TOP {top}" if top is not None else "SELECT"
    return f"{first} {', '.join(columns)} FROM {table}" + (f" WHERE {' AND '.join(where)}" if where else "") + (f" ORDER BY {order}" if order else "")


def inner_join(columns: list[str], tables: list[str], key: str) -> str:
    """Inner joins on one key, as archives with normalised tables want them."""
    first, *more = tables
    return f"SELECT {', '.join(columns)} FROM {first}" + "".join(f" JOIN {t} ON {t}.{key} = {first}.{key}" for t in more)


def literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def http(url: str, timeout: float) -> Callable[[str], bytes]:
    """fetch(query) by the service's synchronous endpoint."""

    def fetch(query: str) -> bytes:
        form = urllib.parse.urlencode({"REQUEST": "doQuery", "LANG": "ADQL", "FORMAT": "votable/td", "QUERY": query}).encode()
        with urllib.request.urlopen(f"{url.rstrip('/')}/sync", form, timeout) as answer:  # noqa: S310
            return answer.read()

    return fetch


def pages(fetch: Callable[[str], bytes], columns: list[str], table: str, mark: str, size: int, after=None, where: list[str] = (), **again) -> Iterator[tuple[dict, object]]:
    """(columns of a page, mark at its end) from `after` on, until a page is short. `mark` is unique and ascends; `again` goes
    to retry."""
    while True:
        beyond = [f"{mark} > {literal(after)}"] if after is not None else []
        page = fits.votable(retry(lambda: fetch(adql(columns, table, size, [*where, *beyond], mark)), **again))
        n = len(page[mark]) if mark in page else 0
        if n:
            after = page[mark][-1]
            after = after if isinstance(after, str) else int(after) if float(after).is_integer() else float(after)
            yield page, after
        if n < size:
            return
