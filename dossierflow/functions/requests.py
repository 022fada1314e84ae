"""Parameters of requests, as strings, to values or to what is wrong with them. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of numbers, ids and times, and limits of the audit page.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z$"
PAGES, PAGE_SIZES, MOST_ACTION = (1, 1000, 1), (10, 100, 25), 128


def whole_number(value: Column) -> Column:
    """A string as a whole number, an empty one as 0; null for null and for what is none."""
    t = F.trim(value)
    number = F.when(t == "", 0.0).when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when((number == F.floor(number)) & (F.abs(number) <= 2.0**53), number.cast("long"))


def audit_parameters(given: Column) -> Column:
    """``struct<page, page_size, action, admin_user_id, from, to, wrong>`` from a map of strings.

    What is missing or null has its default or is null; ``wrong`` names the
    parameters that are not as they should be, in the order above, and their
    values are null. Other keys are ignored; of a null map all is missing.
    """

    def number(name: str, low: int, high: int, default: int) -> tuple[Column, Column]:
        n = whole_number(given[name])
        bad = given[name].isNotNull() & ~F.coalesce(n.between(low, high), F.lit(False))
        return F.when(given[name].isNull(), F.lit(default).cast("long")).when(~bad, n), bad

    def text(name: str, ok) -> tuple[Column, Column]:
        value = F.trim(given[name]) if name == "action" else given[name]
        bad = value.isNotNull() & ~ok(value)
        return F.when(~bad, value), bad

    parts = {
        "page": number("page", *PAGES), "page_size": number("page_size", *PAGE_SIZES), "action": text("action", lambda v: F.length(v) <= MOST_ACTION),
        "admin_user_id": text("admin_user_id", lambda v: v.rlike(UUID)), "from": text("from", lambda v: v.rlike(TIME)), "to": text("to", lambda v: v.rlike(TIME)),
    }
    wrong = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, (_, bad) in parts.items()]))
    return F.struct(*[v.alias(n) for n, (v, _) in parts.items()], wrong.alias("wrong"))


def account_status(status: Column) -> Column:
    """``suspended`` or, whatever else is written or missing, ``active``."""
    return F.when(status == "suspended", "suspended").otherwise("active")
