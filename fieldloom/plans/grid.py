"""Iteration space: extents, vertical regions and the compute box."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

DIMS = ("i", "j", "k")


@dataclass(frozen=True)
class Extent:
    """How far reads reach from a point: (least, greatest) offset in i, j and k; always holds the point itself."""

    i: tuple[int, int] = (0, 0)
    j: tuple[int, int] = (0, 0)
    k: tuple[int, int] = (0, 0)

    def __post_init__(self):
        for d in DIMS:
            low, high = getattr(self, d)
            object.__setattr__(self, d, (min(low, 0), max(high, 0)))

    @classmethod
    def at(cls, di: int = 0, dj: int = 0, dk: int = 0) -> Extent:
        return cls((di, di), (dj, dj), (dk, dk))

    def hull(self, other: Extent) -> Extent:
        return Extent(*((min(a[0], b[0]), max(a[1], b[1])) for a, b in self._pairs(other)))

    def plus(self, other: Extent) -> Extent:
        return Extent(*((a[0] + b[0], a[1] + b[1]) for a, b in self._pairs(other)))

    def horizontal(self) -> Extent:
        return replace(self, k=(0, 0))

    def holds(self, other: Extent) -> bool:
        return all(a[0] <= b[0] and b[1] <= a[1] for a, b in self._pairs(other))

    def _pairs(self, other: Extent):
        return [(getattr(self, d), getattr(other, d)) for d in DIMS]


def enclosing_extents(*extents: Extent) -> Extent:
    out = Extent()
    for e in extents:
        out = out.hull(e)
    return out


def extend_offsets(offsets: Mapping[str, int], extent: Extent) -> dict[str, int]:
    """A box's first point in each dimension, moved to where reads begin."""
    return {d: o + (getattr(extent, d)[0] if d in DIMS else 0) for d, o in offsets.items()}


def extend_sizes(sizes: Mapping[str, int], extent: Extent) -> dict[str, int]:
    """A box's sizes with all points that are read."""
    return {d: n + (getattr(extent, d)[1] - getattr(extent, d)[0] if d in DIMS else 0) for d, n in sizes.items()}


@dataclass(frozen=True)
class Level:
    """A place on the axis: before (offset < 0) or after (offset > 0) a splitter; there is no offset 0."""

    splitter: int
    offset: int

    def moved(self, by: int) -> Level:
        offset = self.offset + by
        if by > 0 and self.offset < 0 <= offset:
            offset += 1
        if by < 0 and offset <= 0 < self.offset:
            offset -= 1
        return replace(self, offset=offset)


@dataclass(frozen=True)
class Interval:
    """Levels first to last, both included."""

    first: Level
    last: Level
    limit: int = 2

    def __post_init__(self):
        for level in (self.first, self.last):
            if not 0 < abs(level.offset) <= self.limit:
                raise ValueError(f"offset {level.offset} is beyond the limit of {self.limit}")
        if self._key(self.first) > self._key(self.last):
            raise ValueError("the interval is empty")

    @staticmethod
    def _key(level: Level) -> tuple[int, int]:
        return level.splitter, level.offset

    def modify(self, left: int, right: int) -> Interval:
        return replace(self, first=self.first.moved(left), last=self.last.moved(right))

    def shift(self, by: int) -> Interval:
        return self.modify(by, by)

    def first_level(self) -> Interval:
        return replace(self, last=self.first)

    def last_level(self) -> Interval:
        return replace(self, first=self.last)

    def enclosing(self, other: Interval) -> Interval:
        return replace(self, first=min(self.first, other.first, key=self._key), last=max(self.last, other.last, key=self._key))

    def concat(self, other: Interval) -> Interval:
        """Union with the interval that begins right after this one."""
        after = self.last.moved(1)
        if other.first not in (after, Level(self.last.splitter, 1)) or self.last.offset not in (-1, other.first.offset - 1):
            raise ValueError("the intervals are not adjacent")
        return replace(self, last=other.last)


class Axis:
    """Vertical regions by their sizes; interval ends may be moved by at most offset_limit levels."""

    def __init__(self, *sizes: int, offset_limit: int = 2):
        if not sizes or min(sizes) < 0:
            raise ValueError("an axis needs regions of size 0 or more")
        self.sizes, self.offset_limit = sizes, offset_limit

    def interval(self, *regions: int) -> Interval:
        """One region, or the hull of consecutive ones."""
        if list(regions) != list(range(regions[0], regions[0] + len(regions))) or regions[-1] >= len(self.sizes):
            raise ValueError("regions must be consecutive regions of the axis")
        return Interval(Level(regions[0], 1), Level(regions[-1] + 1, -1), self.offset_limit)

    def full(self) -> Interval:
        return self.interval(*range(len(self.sizes)))


@dataclass(frozen=True)
class Halo:
    """minus cells before begin and plus after end are halo; end is included in the box."""

    minus: int
    plus: int
    begin: int
    end: int
    total: int

    def __post_init__(self):
        if not (0 <= self.minus <= self.begin <= self.end + 1 and self.end + self.plus < max(self.total, 1) and self.plus >= 0):
            raise ValueError(f"invalid halo {self}")

    def receive(self, side: int) -> range:
        """Cells of the halo on a side (-1 or 1), or of the box (0)."""
        return {-1: range(self.begin - self.minus, self.begin), 0: range(self.begin, self.end + 1), 1: range(self.end + 1, self.end + 1 + self.plus)}[side]

    def send(self, side: int) -> range:
        """Cells of the box that the neighbour on a side needs: its halo there is of the mirrored width."""
        return {-1: range(self.begin, self.begin + self.plus), 0: range(self.begin, self.end + 1), 1: range(self.end + 1 - self.minus, self.end + 1)}[side]


@dataclass(frozen=True)
class Grid:
    """Compute box in i and j, and the vertical axis from level 0."""

    i0: int
    ni: int
    j0: int
    nj: int
    axis: Axis

    @property
    def nk(self) -> int:
        return sum(self.axis.sizes)

    def level(self, level: Level) -> int:
        return sum(self.axis.sizes[: level.splitter]) + level.offset - (level.offset > 0)

    def levels(self, interval: Interval) -> range:
        return range(max(self.level(interval.first), 0), min(self.level(interval.last) + 1, self.nk))

    def k_start(self, interval: Interval, backward: bool = False) -> int:
        return self.level(interval.last if backward else interval.first)

    def k_size(self, interval: Interval) -> int:
        return 1 + self.level(interval.last) - self.level(interval.first)


def make_grid(i: int | Halo, j: int | Halo, k: int | Axis) -> Grid:
    """A box from sizes (from 0 on) or halos (from begin to end), with one region of k levels or an axis."""
    box = [(0, d) if isinstance(d, int) else (d.begin, d.end + 1 - d.begin) for d in (i, j)]
    return Grid(*box[0], *box[1], k if isinstance(k, Axis) else Axis(k))
