"""Parsing of request parameters, on the driver: they are scalars of one request."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import urlencode

#: Limits of requests, and how many hits a leg fetches.
MOST_QUERY, PAGE, LIMIT, MOST_LIMIT, OVERFETCH, LEAST_WINDOW = 500, 1, 20, 50, 8, 60
MOST_QUESTION = 2000
TYPES = ("pdf", "image", "note", "video")


class RequestError(ValueError):
    """A bad request; ``status`` is its HTTP status."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def checked_query(query: str) -> str:
    q = query.strip()
    if not q:
        raise RequestError("The query is empty")
    if len(q) > MOST_QUERY:
        raise RequestError(f"The query has more than {MOST_QUERY} characters")
    return q


def checked_question(question: object) -> str:
    if not isinstance(question, str):
        raise RequestError("The question is no text")
    q = re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", question)).strip()
    if not q:
        raise RequestError("The question is empty")
    if len(q) > MOST_QUESTION:
        raise RequestError(f"The question has more than {MOST_QUESTION} characters")
    return q


def _leading_int(value: object) -> int | None:
    m = re.match(r"\s*[+-]?\d+", "" if value is None else str(value))
    return int(m[0]) if m else None


def page_of(value: object) -> int:
    n = _leading_int(value)
    return n if n is not None and n >= 1 else PAGE


def limit_of(value: object) -> int:
    n = _leading_int(value)
    return min(n, MOST_LIMIT) if n is not None and n >= 1 else LIMIT


def type_of(value: object, allowed: tuple[str, ...] = TYPES) -> str | None:
    return value if isinstance(value, str) and value in allowed else None


def window_of(page: int, limit: int) -> int:
    """Hits that each leg fetches: more for later pages."""
    return max(limit * page * OVERFETCH, LEAST_WINDOW)


def tokens(query: str) -> list[str]:
    """Terms of a query, repeated ones again."""
    return [t for t in (re.sub(r"[^A-Za-z0-9_-]", "", x) for x in query.lower().split()) if len(t) >= 2]


def phrases(query: str) -> list[str]:
    """What stands in double quotes, and the whole query from four characters on, quotes included."""
    found = [p.strip().lower() for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    whole = query.strip().lower()
    return [*found, whole] if len(whole) >= 4 and whole not in found else found


@dataclass(frozen=True)
class Filter:
    """What restricts a search; ``date`` is today, 7d, 30d or custom, any other preset restricts nothing."""

    type: str | None = None
    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    topic: str | None = None
    tag: str | None = None


def date_range(f: Filter, now: datetime) -> tuple[datetime | None, datetime | None]:
    """The instants from and to, both inclusive; a bare date is its midnight in UTC."""
    end = now.replace(hour=23, minute=59, second=59, microsecond=999000)
    if f.date == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0), end
    if f.date in ("7d", "30d"):
        return now - timedelta(days=int(f.date[:-1])), end
    if f.date == "custom":
        out = []
        for name, value in (("dateFrom", f.date_from), ("dateTo", f.date_to)):
            try:
                t = datetime.fromisoformat(value.replace("Z", "+00:00")) if value else None
            except ValueError:
                raise RequestError(f"{name} is no date") from None
            out.append(t.astimezone(UTC).replace(tzinfo=None) if t and t.tzinfo else t)
        return out[0], out[1]
    return None, None


def query_string(query: str, page: int | None = None, limit: int | None = None, f: Filter | None = None) -> str:
    """A search as parameters of an address; topic and tag are not sent."""
    f = f or Filter()
    named = {"q": query, "page": page, "limit": limit, "type": f.type, "date": f.date, "dateFrom": f.date_from, "dateTo": f.date_to}
    return urlencode({k: v for k, v in named.items() if k == "q" or v})
