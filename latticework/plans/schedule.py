"""Which report periods to run, in which order, and which share one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from latticework.plans.frequency import Frequency
from latticework.plans.spec import Priority, ReportSpec
from latticework.sources.paths import expand


@dataclass(frozen=True)
class Work:
    """One report for one period."""

    spec: ReportSpec
    freq: Frequency
    start: datetime

    @property
    def raw(self) -> bool:
        """Whether it reads the report's input; else it merges states of finer periods."""
        return self.freq is self.spec.min_freq

    @property
    def key(self) -> tuple[str, str, datetime]:
        return self.spec.name, self.freq.value, self.start

    @property
    def source(self) -> tuple | None:
        """What two pieces of work must have in common to share a scan."""
        if not self.raw or self.spec.input is None:
            return None
        inp = self.spec.input
        return inp.file_type, inp.data_type, tuple(sorted(expand(inp.paths, self.start, self.freq.end(self.start)))), inp.fields


@dataclass
class Unit:
    """Work that runs as one: reports fused on one scan, or one alone."""

    works: list[Work]
    after: set[int] = field(default_factory=set)  # indices of units that must have ended

    @property
    def priority(self) -> Priority:
        return min(w.spec.priority for w in self.works)

    @property
    def strong(self) -> int:
        return self.priority.strong


@dataclass
class Plan:
    units: list[Unit]

    def levels(self) -> list[list[int]]:
        """Unit indices in waves: a wave needs earlier ones alone; launches within it go by weak priority."""
        done: set[int] = set()
        left, waves = set(range(len(self.units))), []
        while left:
            ready = [i for i in left if self.units[i].after <= done]
            if not ready:
                raise ValueError("the plan has a cycle")
            barrier = min(self.units[i].strong for i in left)
            open_ = [i for i in ready if self.units[i].strong == barrier] or ready
            wave = sorted(open_, key=lambda i: (self.units[i].priority, i))
            waves.append(wave)
            done |= set(wave)
            left -= set(wave)
        return waves


def needed(work: Work, exists: Callable[[Work], bool], force: bool = False) -> tuple[list[Work], dict[tuple, set[tuple]]]:
    """The work to do for one period with what must come before it.

    A period that exists isn't run again unless forced; its children are never
    forced.  Children are scheduled only for a report whose check is ``all``:
    others merge what states there are.
    """
    found: dict[tuple, Work] = {}
    before: dict[tuple, set[tuple]] = {}

    def visit(w: Work, forced: bool) -> bool:
        if w.key in found:
            return True
        if not forced and exists(w):
            return False
        if not w.raw and not w.freq.coarser_than(w.spec.min_freq):
            raise ValueError(f"{w.spec.name}: {w.freq.value} is finer than its finest grain {w.spec.min_freq.value}")
        if not w.raw and w.freq.child is not None and w.spec.min_freq.coarser_than(w.freq.child):
            raise ValueError(f"{w.spec.name}: {w.freq.value} merges {w.freq.child.value} states, finer than {w.spec.min_freq.value}")
        before[w.key] = set()
        if not w.raw and (w.spec.input is None or w.spec.input.check == "all"):
            for start in w.freq.children(w.start):
                child = Work(w.spec, w.freq.child, start)
                if visit(child, False):
                    before[w.key].add(child.key)
        found[w.key] = w
        return True

    visit(work, force)
    return list(found.values()), before


def build(works: Iterable[Work], exists: Callable[[Work], bool], force: bool = False) -> Plan:
    """The plan for several periods; raw work of equal strong priority, period and input is fused."""
    every: dict[tuple, Work] = {}
    before: dict[tuple, set[tuple]] = {}
    for w in works:
        more, deps = needed(w, exists, force)
        every.update({m.key: m for m in more})
        for k, v in deps.items():
            before.setdefault(k, set()).update(v)
    units: list[Unit] = []
    at: dict[tuple, int] = {}
    fused: dict[tuple, int] = {}
    for w in every.values():
        share = (w.spec.priority.strong, w.freq, w.start, w.source) if w.source else None
        if share in fused and share is not None:
            units[fused[share]].works.append(w)
        else:
            units.append(Unit([w]))
            if share is not None:
                fused[share] = len(units) - 1
        at[w.key] = fused[share] if share is not None else len(units) - 1
    for key, needs in before.items():
        units[at[key]].after |= {at[n] for n in needs if n in at} - {at[key]}
    return Plan(units)


def strict_checks(works: Sequence[Work]) -> list[str]:
    return [w.spec.input.check for w in works if w.spec.input]
