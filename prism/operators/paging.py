"""Pages of ordered results: cursors that name an offset, a probe of one row more, and the snapshot a cursor belongs to."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

# Rows of a page where the caller names none, of lists and of searches.
PAGE, SEARCH_PAGE = 1000, 20


class BadCursor(ValueError):
    """Not a token of an earlier page, or one of another state of the index."""


def encode_cursor(offset: int, snapshot: str | None = None) -> str:
    body = {"v": 1, "offset": offset} | ({} if snapshot is None else {"snapshot": snapshot})
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, snapshot: str | None = None) -> int:
    """The offset of a cursor; one that was made over another snapshot is refused."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        offset, version = body["offset"], body["v"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadCursor(f"{cursor!r} is no token of an earlier page") from e
    if version != 1 or type(offset) is not int or offset < 0:
        raise BadCursor(f"{cursor!r} is no token of an earlier page")
    if snapshot is not None and body.get("snapshot") != snapshot:
        raise BadCursor("the index changed since that page; begin again")
    return offset


@dataclass(frozen=True)
class Window:
    """Which rows a page shows: offset to end; depth is one more, to see whether others follow."""

    offset: int
    limit: int

    @property
    def end(self) -> int:
        return self.offset + self.limit

    @property
    def depth(self) -> int:
        return self.end + 1


def window(limit: int | None = None, cursor: str | None = None, snapshot: str | None = None, usual: int = PAGE) -> Window:
    if limit is not None and (type(limit) is not int or limit < 1):
        raise ValueError(f"limit must be a whole number of at least 1, not {limit!r}")
    return Window(0 if cursor is None else decode_cursor(cursor, snapshot), limit or usual)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int | None  # of all rows, where the page is the last
    next_cursor: str | None
    reached: bool


def page(rows: DataFrame, order: list[Column], w: Window, snapshot: str | None = None) -> Page:
    """The rows of a page in order. One top-k of offset + limit + 1 rows; none beyond are sorted or counted."""
    head = rows.orderBy(*order).limit(w.depth)
    seen = head.count()
    more = seen > w.end
    shown = head.orderBy(*order).limit(w.end).offset(w.offset)
    return Page(shown, None if more else seen, encode_cursor(w.end, snapshot) if more else None, more)


def by_place(path: str = "path", seq: str = "seq") -> list[Column]:
    """The order of facts: path by code point, then place in the document."""
    from pyspark.sql import functions as F

    return [F.asc(path), F.asc(seq)]
