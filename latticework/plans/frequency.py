"""Report periods: eight grains, their ends, children and directories."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import datetime, timedelta
from enum import Enum


def add_months(moment: datetime, months: int) -> datetime:
    """The same day and time some months later; a day that the month lacks becomes its last."""
    years, month = divmod(moment.month - 1 + months, 12)
    year = moment.year + years
    return moment.replace(year=year, month=month + 1, day=min(moment.day, calendar.monthrange(year, month + 1)[1]))


class Frequency(Enum):
    """Grains from fine to coarse. A period starts at any moment: no calendar alignment is enforced."""

    Hourly = "Hourly"
    Daily = "Daily"
    Weekly = "Weekly"
    Monthly = "Monthly"
    Thirtydays = "Thirtydays"
    Quarterly = "Quarterly"
    HalfYearly = "HalfYearly"
    Yearly = "Yearly"

    @property
    def rank(self) -> int:
        return list(Frequency).index(self)

    def coarser_than(self, other: Frequency) -> bool:
        return self.rank > other.rank

    def end(self, start: datetime) -> datetime:
        """The end (exclusive) of the period that starts at ``start``."""
        if self in _DELTAS:
            return start + _DELTAS[self]
        return add_months(start, _MONTHS[self])

    @property
    def child(self) -> Frequency | None:
        """The grain whose states this one merges; none below the hour."""
        return _CHILDREN.get(self)

    def starts(self, start: datetime, end: datetime) -> Iterator[datetime]:
        """The starts of this grain's periods from ``start`` up to ``end``."""
        step, at = 0, start
        while at < end:
            yield at
            step += 1
            # month steps count from the first start, so the 31st doesn't slide to the 28th
            at = start + step * _DELTAS[self] if self in _DELTAS else add_months(start, step * _MONTHS[self])

    def children(self, start: datetime) -> list[datetime]:
        """The starts of the child periods within the period from ``start``."""
        return list(self.child.starts(start, self.end(start))) if self.child else []

    def date_dir(self, start: datetime) -> str:
        return start.strftime("%Y-%m-%d/%H" if self is Frequency.Hourly else "%Y-%m-%d")


_DELTAS = {Frequency.Hourly: timedelta(hours=1), Frequency.Daily: timedelta(days=1), Frequency.Weekly: timedelta(days=7), Frequency.Thirtydays: timedelta(days=30)}
_MONTHS = {Frequency.Monthly: 1, Frequency.Quarterly: 3, Frequency.HalfYearly: 6, Frequency.Yearly: 12}
_CHILDREN = {
    Frequency.Daily: Frequency.Hourly,
    **dict.fromkeys((Frequency.Weekly, Frequency.Monthly, Frequency.Thirtydays), Frequency.Daily),
    **dict.fromkeys((Frequency.Quarterly, Frequency.HalfYearly, Frequency.Yearly), Frequency.Monthly),
}

_PERIOD_FORMAT = "%Y-%m-%dT%H:%MZ"


def parse_period(text: str) -> datetime:
    """A period start such as ``2024-01-31T07:00Z``, in UTC."""
    return datetime.strptime(text, _PERIOD_FORMAT)


def format_period(start: datetime) -> str:
    return start.strftime(_PERIOD_FORMAT)
