"""Rule resolution: from dimensions and rules to the sets of dimensions rolled up together."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from latticework.plans.spec import Bind, Filter, Ignore, Rule, SpecError


@dataclass(frozen=True)
class RollUp:
    """One way to roll up: these dimensions become ALL, for rows that pass these filters."""

    dims: tuple[str, ...]
    filters: tuple[Filter, ...]


@dataclass
class CuboidPlan:
    dims: list[str]
    leaders: dict[str, tuple[str, ...]]  # cube dimension -> itself and its followers
    filters: dict[str, Filter]
    ignored: set[str]
    warnings: list[str] = field(default_factory=list)

    def roll_ups(self) -> list[RollUp]:
        """Every subset of the cube dimensions once, the empty one first."""
        cube = [d for d in self.dims if d not in self.ignored]
        out = []
        for n in range(len(cube) + 1):
            for some in combinations(cube, n):
                rolled = {m for d in some for m in self.leaders.get(d, (d,))}
                out.append(RollUp(tuple(d for d in self.dims if d in rolled), tuple(self.filters[d] for d in some if d in self.filters)))
        return out


def resolve(dims: Iterable[str], rules: Sequence[Rule]) -> CuboidPlan:
    """The plan for sorted dimensions under the rules, taken in their order.

    Ignoring a bound leader ignores its followers too; a bind whose leader is
    ignored or filtered is skipped; the first filter of a dimension wins, and one
    on an ignored or leading dimension is skipped.  Names match in any case.
    """
    dims = sorted(dims)
    known = {d.lower(): d for d in dims}
    plan = CuboidPlan(dims, {}, {}, set())

    def real(name: str) -> str:
        if name.lower() not in known:
            raise SpecError(f"a rule names the unknown dimension {name!r}")
        return known[name.lower()]

    def ignore(name: str) -> None:
        if name in plan.filters:
            plan.warnings.append(f"{name} is ignored: its filter has no effect")
            del plan.filters[name]
        plan.ignored.add(name)
        for follower in plan.leaders.pop(name, ())[1:]:
            plan.ignored.add(follower)

    for rule in rules:
        if isinstance(rule, Ignore):
            for name in map(real, rule.dims):
                ignore(name)
        elif isinstance(rule, Bind):
            leader, *others = map(real, rule.dims)
            if leader in plan.ignored or leader in plan.filters:
                plan.warnings.append(f"bind {','.join(rule.dims)} is skipped: {leader} is ignored or filtered")
                continue
            followers = list(plan.leaders.get(leader, (leader,)))
            for name in others:
                if name == leader:
                    continue
                if name in plan.ignored:
                    plan.warnings.append(f"{name} is ignored, and still becomes ALL with {leader}")
                ignore(name)
                if name not in followers:
                    followers.append(name)
            plan.leaders[leader] = tuple(followers)
        else:
            dim = real(rule.dim)
            related = real(rule.related) if rule.related else None
            if dim in plan.ignored or dim in plan.filters or dim in plan.leaders:
                plan.warnings.append(f"the filter on {dim} is skipped: it is ignored, bound or filtered already")
                continue
            if related == dim:
                raise SpecError(f"a filter relates {dim} to itself")
            if related and any(related in members[1:] for members in plan.leaders.values()):
                raise SpecError(f"a filter's related dimension {related} follows another: it may be ALL when the filter is asked")
            plan.filters[dim] = Filter(dim, rule.kind, rule.values, rule.config, related)
            if related:
                ignore(related)
    return plan
