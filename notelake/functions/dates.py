"""Three definitions of staleness, which differ on purpose, and ISO weeks. The clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def moment(text: Column) -> Column:
    """A date or an RFC 3339 time as seconds; null if it is neither."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    return F.coalesce(day, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.unix_seconds(text.try_cast("timestamp"))))


def recall_stale(verified: Column, updated: Column, freshness_days: Column, now_s: Column) -> Column:
    """For answers: verified, else updated; undatable is stale; no budget is never stale."""
    when = F.coalesce(moment(verified), moment(updated))
    return F.when(freshness_days <= 0, F.lit(False)).otherwise(F.coalesce(now_s - when > freshness_days.cast("long") * DAY, F.lit(True)))


def index_stale(verified_s: Column, freshness_days: Column, now_s: Column) -> Column:
    """For the index: verified alone, in fractions of a day; unmeasured is not stale."""
    return F.coalesce((freshness_days > 0) & ((now_s - verified_s) / F.lit(float(DAY)) > freshness_days), F.lit(False))


def days_overdue(verified_s: Column, freshness_days: Column, now_s: Column) -> Column:
    """For the report: whole days past the budget, null unless positive."""
    over = F.floor((now_s - verified_s) / F.lit(DAY)).cast("long") - freshness_days
    return F.when((freshness_days > 0) & verified_s.isNotNull() & (over > 0), over)


def week_key(when: Column) -> Column:
    """YYYY-Www with the ISO year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), when).cast("int"), F.weekofyear(when))
