"""The standard kernels, as operators of the stencil frontend."""

from __future__ import annotations

from fieldloom.plans.expr import where
from fieldloom.plans.spec import Spec, execute_backward, execute_forward, execute_parallel, in_, inout, multi_pass, operator

NEAR = {"i": (-1, 1), "j": (-1, 1)}


@operator(inp=in_(), out=inout())
def copy(inp, out):
    return {"out": inp()}


@operator(inp=in_(**NEAR), out=inout())
def laplacian(inp, out):
    return {"out": 4.0 * inp() - (inp(i=1) + inp(j=1) + inp(i=-1) + inp(j=-1))}


@operator(lap=in_(i=(0, 1)), inp=in_(i=(0, 1)), out=inout())
def flux_i(lap, inp, out):
    res = lap(i=1) - lap()
    return {"out": where(res * (inp(i=1) - inp()) > 0, 0.0, res)}


@operator(lap=in_(j=(0, 1)), inp=in_(j=(0, 1)), out=inout())
def flux_j(lap, inp, out):
    res = lap(j=1) - lap()
    return {"out": where(res * (inp(j=1) - inp()) > 0, 0.0, res)}


@operator(inp=in_(), coeff=in_(), flx=in_(i=(-1, 0)), fly=in_(j=(-1, 0)), out=inout())
def diffuse(inp, coeff, flx, fly, out):
    return {"out": inp() - coeff() * (flx() - flx(i=-1) + fly() - fly(j=-1))}


def horizontal_diffusion(inp: str = "value", coeff: str = "coeff", out: str = "out", kind: str = "double") -> Spec:
    """Laplacian, limited fluxes and their divergence: four stages, halo 2.  kind: double or float, of the temporaries."""
    stages = execute_parallel().stage(laplacian, inp=inp, out="lap").stage(flux_i, lap="lap", inp=inp, out="flx").stage(flux_j, lap="lap", inp=inp, out="fly")
    return multi_pass(stages.stage(diffuse, inp=inp, coeff=coeff, flx="flx", fly="fly", out=out), temps=dict.fromkeys(("lap", "flx", "fly"), kind))


@operator(inp=in_(**NEAR), north=in_(), south=in_(), out=inout())
def weighed_laplacian(inp, north, south, out):
    """Differences along j have weights, which may vary along j."""
    return {"out": inp(i=1) + inp(i=-1) - 2.0 * inp() + north() * (inp(j=1) - inp()) + south() * (inp(j=-1) - inp())}


@operator(inp=in_(), lap=in_(**NEAR), north=in_(), coeff=in_(), out=inout())
def flux_divergence(inp, lap, north, coeff, out):
    along_i = (lap() - lap(i=-1)) - (lap(i=1) - lap())
    along_j = north() * (lap() - lap(j=-1)) - north() * (lap(j=1) - lap())
    return {"out": inp() + (along_i + along_j) * coeff()}


def simple_diffusion(inp: str = "value", north: str = "north", south: str = "south", coeff: str = "coeff", out: str = "out") -> Spec:
    """Unlimited fourth-order diffusion with weights along j: two stages, halo 2."""
    stages = execute_parallel().stage(weighed_laplacian, inp=inp, north=north, south=south, out="lap")
    return multi_pass(stages.stage(flux_divergence, inp=inp, lap="lap", north=north, coeff=coeff, out=out), temps=("lap",))


@operator(inp=in_(), density=in_(), out=inout())
def prepare_tracer(inp, density, out):
    return {"out": density() * inp()}


def tridiagonal(grid, inf: str = "inf", diag: str = "diag", sup: str = "sup", rhs: str = "rhs", out: str = "out") -> Spec:
    """Thomas: a forward sweep, then a backward one."""
    from fieldloom.plans.spec import Operator

    full = grid.axis.full()
    first, body, last = full.first_level(), full.modify(1, 0), full.modify(0, -1)

    def fwd_first(diag, sup, rhs, c, d):
        return {"c": sup() / diag(), "d": rhs() / diag()}

    def fwd(inf, diag, sup, rhs, c, d):
        below = diag() - c(k=-1) * inf()
        return {"c": sup() / below, "d": (rhs() - inf() * d(k=-1)) / below}

    up = Operator({first: fwd_first, body: fwd}, inf=in_(), diag=in_(), sup=in_(), rhs=in_(), c=inout(k=(-1, 0)), d=inout(k=(-1, 0)))
    down = Operator({full.last_level(): lambda d, out: {"out": d()}, last: lambda c, d, out: {"out": d() - c() * out(k=1)}}, c=in_(), d=in_(), out=inout(k=(0, 1)))
    return multi_pass(
        execute_forward().stage(up, inf=inf, diag=diag, sup=sup, rhs=rhs, c="c", d="d"),
        execute_backward().stage(down, c="c", d="d", out=out), temps=("c", "d"),
    )


#: Weights of the old and the new velocity in the implicit step.
OLD, NEW = 0.5, 0.5


def vertical_advection(grid, dtr: float = 3.0 / 20.0, u_stage: str = "u_stage", wcon: str = "wcon", u_pos: str = "u_pos", utens: str = "utens", utens_stage: str = "utens_stage", out: str = "utens_out") -> Spec:
    """Implicit advection along k: assemble each column's tridiagonal system, solve it, and take the tendency.

    A level's exchange with the one below is minus a quarter of wcon at it, summed over i and i + 1; with the one above it is a
    quarter of wcon at that one.  wcon is read at i + 1 and k + 1.
    """
    from fieldloom.plans.spec import Operator

    full = grid.axis.full()
    reads = {"u": in_(k=(-1, 1)), "w": in_(i=(0, 1), k=(0, 1)), "pos": in_(), "tens": in_(), "tens_stage": in_()}
    writes = {n: inout() for n in ("inf", "diag", "sup", "rhs")}

    def system(below: bool, above: bool):
        def row(u, w, pos, tens, tens_stage):
            down = -0.25 * (w(i=1) + w()) if below else 0.0
            up = 0.25 * (w(i=1, k=1) + w(k=1)) if above else 0.0
            known = dtr * pos() + tens() + tens_stage()
            if below:
                known = known - down * OLD * (u(k=-1) - u())
            if above:
                known = known - up * OLD * (u(k=1) - u())
            return {"inf": down * NEW, "diag": dtr - down * NEW - up * NEW, "sup": up * NEW, "rhs": known}

        return row

    cases = {full.first_level(): system(False, True), full.modify(1, -1): system(True, True), full.last_level(): system(True, False)}
    assemble = execute_parallel().stage(Operator(cases, **reads, **writes), u=u_stage, w=wcon, pos=u_pos, tens=utens, tens_stage=utens_stage, **{n: f"__{n}" for n in writes})
    solve = tridiagonal(grid, *(f"__{n}" for n in writes), out="__x")
    tendency = Operator(lambda x, pos, out: {"out": dtr * (x() - pos())}, x=in_(), pos=in_(), out=inout())
    return multi_pass(assemble, *solve.multistages, execute_parallel().stage(tendency, x="__x", pos=u_pos, out=out), temps=(*(f"__{n}" for n in writes), "__x", *solve.temps))
