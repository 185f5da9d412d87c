"""Date windows as disjoint intervals: what a scan has to read for several criteria."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Interval:
    """Days ``start`` to ``end``, both included; ``codes`` that count in it, None for any."""

    start: dt.date
    end: dt.date
    codes: frozenset[str] | None


def disjoint(windows: list[tuple[dt.date, dt.date, frozenset[str] | None]]) -> list[Interval]:
    """The days that some window holds, ascending, cut where the set of codes that count changes.

    A window that ends before it starts holds no day. Codes are joined over the
    windows open on a day; with one whose codes aren't known any code counts.
    """
    windows = [w for w in windows if w[0] <= w[1]]
    # a window opens at its first day's number and closes the day after its last
    cuts = sorted({w[0].toordinal() for w in windows} | {w[1].toordinal() + 1 for w in windows})
    out: list[Interval] = []
    for day, after in zip(cuts, cuts[1:]):
        open_ = [codes for start, end, codes in windows if start.toordinal() <= day <= end.toordinal()]
        if not open_:
            continue
        codes = None if any(c is None for c in open_) else frozenset().union(*open_)
        start, end = dt.date.fromordinal(day), dt.date.fromordinal(after - 1)
        if out and out[-1].codes == codes and out[-1].end.toordinal() + 1 == day:
            out[-1] = Interval(out[-1].start, end, codes)
        else:
            out.append(Interval(start, end, codes))
    return out
