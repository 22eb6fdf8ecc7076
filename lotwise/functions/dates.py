"""Deadlines and days out of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before an expiry date; the first of them that occurs counts.
EXPIRY_WORDS = ("Истекает", "истекает", "expires", "Expires", "deadline", "Deadline", "до ")
#: Date patterns in order; the last valid date of the last pattern that has one is the deadline.
PATTERNS = (
    (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
)


def _last_date(text: Column) -> Column:
    def of(pattern: str, form: str) -> Column:
        days = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: F.try_to_timestamp(x, F.lit(form)).cast("date"))
        return F.try_element_at(F.filter(days, lambda x: x.isNotNull()), F.lit(-1))

    return F.coalesce(*[F.when(F.size(F.regexp_extract_all(text, F.lit(f"({p})"), 1)) > 0, of(p, f)) for p, f in reversed(PATTERNS)])


def deadline_day(text: Column) -> Column:
    """The day of a deadline's text: the last date after an expiry word, or of the whole text."""
    tail = F.coalesce(*[F.when(text.contains(w), F.substring(text, F.instr(text, w), F.length(text))) for w in EXPIRY_WORDS], text)
    return F.coalesce(_last_date(tail), _last_date(text))


def deadline_expired(text: Column, now: Column) -> Column:
    """Past its time if it has one (an ISO time of the deadline's day, midnight without a zone excepted), else a day late."""
    day = deadline_day(text)
    stamp = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
    own = F.filter(F.regexp_extract_all(text, F.lit(stamp), 1), lambda x: F.substring(x, 1, 10) == F.date_format(day, "yyyy-MM-dd"))
    last = F.try_element_at(own, F.lit(-1))
    placeholder = last.rlike(r"^.{10}[T ]00:00(:00)?(\.\d+)?$")
    exact = F.when(~placeholder, F.replace(last, F.lit(" "), F.lit("T")).try_cast("timestamp"))
    late = F.when(exact.isNotNull(), exact < now).otherwise(day.cast("timestamp") < now - F.expr("INTERVAL 1 DAY"))
    return F.coalesce(late, F.lit(False))


def iso_day(value: Column) -> Column:
    """The day in the first ten characters, by three formats, within 2000 to 2099."""
    head = F.substring(F.trim(value), 1, 10)
    day = F.coalesce(*[F.try_to_timestamp(head, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")])
    return F.when(F.year(day).between(2000, 2099), day)


def close_days(a: Column, b: Column, most: int = 3) -> Column:
    """Whether two days are at most `most` apart; an unknown one is close to all."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= most, F.lit(True))


def either(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)
