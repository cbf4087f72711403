import json

import pytest

from fieldloom.plans.grid import Axis, Extent, Halo, Interval, Level, enclosing_extents, extend_offsets, extend_sizes, make_grid
from fieldloom.plans.spec import Operator, Spec, SpecError, execute_forward, execute_parallel, in_, inout, multi_pass


def test_intervals():
    axis = Axis(3, 4)
    grid = make_grid(5, 6, axis)
    full = axis.full()
    assert list(grid.levels(full)) == list(range(7))
    assert list(grid.levels(axis.interval(1))) == [3, 4, 5, 6]
    assert list(grid.levels(full.first_level())) == [0] and list(grid.levels(full.last_level())) == [6]
    assert list(grid.levels(full.modify(1, -1))) == [1, 2, 3, 4, 5]
    assert list(grid.levels(axis.interval(0).shift(1))) == [1, 2, 3]
    assert axis.interval(0).enclosing(axis.interval(1)) == full
    assert grid.levels(axis.interval(0).concat(axis.interval(1))) == grid.levels(full)
    assert (grid.k_start(full), grid.k_start(full, backward=True), grid.k_size(full)) == (0, 6, 7)
    with pytest.raises(ValueError):
        full.modify(3, 0)
    with pytest.raises(ValueError):
        Interval(Level(1, 1), Level(0, 1))
    with pytest.raises(ValueError):
        axis.interval(0, 2)


def test_halo():
    h = Halo(2, 3, 2, 6, 10)
    assert (list(h.receive(-1)), list(h.receive(0)), list(h.receive(1))) == ([0, 1], [2, 3, 4, 5, 6], [7, 8, 9])
    assert (list(h.send(-1)), list(h.send(1))) == ([2, 3, 4], [5, 6])  # mirrored widths
    with pytest.raises(ValueError):
        Halo(3, 0, 2, 6, 10)
    assert make_grid(h, 4, 5).i0 == 2 and make_grid(h, 4, 5).ni == 5


def _chain():
    wide = Operator(lambda a, b: {"b": a(i=1) + a(i=-1)}, a=in_(i=(-1, 1)), b=inout())
    side = Operator(lambda a, b: {"b": a(j=2)}, a=in_(j=(0, 2)), b=inout())
    return multi_pass(execute_parallel().stage(wide, a="x", b="t").stage(side, a="t", b="u").stage(wide, a="u", b="y"), temps=("t", "u"))


def test_extents():
    spec = _chain()
    assert spec.compute_extents() == [Extent((-1, 1), (0, 2)), Extent((-1, 1)), Extent()]
    assert spec.arg_extents()["x"] == Extent((-2, 2), (0, 2))
    assert spec.arg_intent("x") == "in" and spec.arg_intent("t") == "inout"
    plan = json.loads(spec.explain_json(make_grid(4, 4, 3)))
    assert plan["multistages"][0]["stages"][0]["extent"] == {"i": [-1, 1], "j": [0, 2]}
    forced = Spec((execute_parallel().stage(Operator(lambda a, b: {"b": a()}, a=in_(), b=inout()), extent=Extent((-1, 1)), a="x", b="y"),))
    assert forced.compute_extents() == [Extent((-1, 1))]


def test_rules():
    copy = Operator(lambda a, b: {"b": a()}, a=in_(), b=inout())
    near = Operator(lambda a, b: {"b": a(i=1)}, a=in_(i=(0, 1)), b=inout())
    grid = make_grid(4, 4, 3)
    for broken in (
        multi_pass(execute_parallel().stage(copy, a="x", b="y").stage(copy, a="z", b="y")),
        multi_pass(execute_parallel().stage(near, a="y", b="z").stage(copy, a="x", b="y")),
        multi_pass(execute_parallel().stage(copy, a="x", b="y"), temps=("x",)),
        multi_pass(execute_parallel().stage(copy, a="x", b="y").k_cached("y")),
        multi_pass(execute_parallel().stage(copy, a="x", b="y").ij_cached("q")),
    ):
        with pytest.raises(SpecError):
            broken.validate(grid)
    with pytest.raises(SpecError):
        Operator(lambda b: {}, b=type(inout())(True, Extent((-1, 0))))
    with pytest.raises(SpecError):
        execute_forward().stage(copy, a="x")
    with pytest.raises(SpecError):
        Spec((execute_parallel().stage(Operator(lambda a, b: {"b": a(i=1)}, a=in_(), b=inout()), a="x", b="y"),)).validate(grid)
    axis = Axis(2, 2)
    overlapping = Operator({axis.full(): lambda a, b: {"b": a()}, axis.interval(0): lambda a, b: {"b": a()}}, a=in_(), b=inout())
    with pytest.raises(SpecError):
        multi_pass(execute_parallel().stage(overlapping, a="x", b="y")).validate(make_grid(2, 2, axis))


def test_extent_algebra():
    e = enclosing_extents(Extent.at(1, 0, 0), Extent.at(-2, 0, 1))
    assert e == Extent((-2, 1), (0, 0), (0, 1))
    assert extend_offsets({"i": 5, "k": 0}, e) == {"i": 3, "k": 0} and extend_sizes({"i": 4, "k": 2}, e) == {"i": 7, "k": 3}
