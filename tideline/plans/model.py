"""Declared models, and their compilation to the small matrices a plan carries.

Nothing here touches data: a compiled model is a few numbers that operators turn
into Column expressions.  Amplitudes fixed at zero are dropped from the noise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from tideline.functions.scale import contrasts


def _finite(*values: float) -> None:
    if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in values):
        raise ValueError(f"priors need finite numbers, not {values}")


def _positive(*values: float) -> None:
    _finite(*values)
    if not all(v > 0 for v in values):
        raise ValueError(f"scales must be positive, not {values}")


@dataclass(frozen=True)
class Normal:
    mean: float = 0.0
    sd: float = 1.0

    def __post_init__(self):
        _finite(self.mean)
        _positive(self.sd)


@dataclass(frozen=True)
class HalfNormal:
    sd: float = 1.0

    def __post_init__(self):
        _positive(self.sd)


@dataclass(frozen=True)
class InverseGamma:
    shape: float = 2.0
    scale: float = 2.0

    def __post_init__(self):
        _positive(self.shape, self.scale)


@dataclass(frozen=True)
class Fixed:
    value: float

    def __post_init__(self):
        _finite(self.value)


#: The groups of state noise that every model may have.
GROUPS = ("level", "slope", "seasonal")


# The default priors.
@dataclass(frozen=True)
class Priors:
    initial_level: Normal | Fixed = Normal(0.0, 10.0)
    initial_slope: Normal | Fixed = Normal(0.0, 0.01)
    initial_seasonal: Normal | Fixed = Normal(0.0, 10.0)
    level: Normal | Fixed = Normal(0.0, 0.1)
    slope: Normal | Fixed = Normal(0.0, 0.002)
    seasonal: Normal | Fixed = Normal(0.0, 0.1)
    variance: InverseGamma | Fixed = InverseGamma()
    shape: Normal | Fixed = Normal(0.0, 0.3)

    def __post_init__(self):
        if isinstance(self.variance, Fixed) and not self.variance.value > 0:
            raise ValueError("a fixed variance must be positive")
        # an amplitude's sign isn't known: its prior is even, and a fixed one is a size
        wrong = [n for n in GROUPS if (getattr(self, n).value < 0 if isinstance(getattr(self, n), Fixed) else getattr(self, n).mean != 0)]
        if wrong:
            raise ValueError(f"amplitudes need priors centred on zero or fixed values of zero or more: {wrong}")


@dataclass(frozen=True)
class Pooling:
    """Half-normal priors of scales that channels share."""

    level: HalfNormal | None = None
    slope: HalfNormal | None = None
    seasonal: HalfNormal | None = None
    groups: dict[str, HalfNormal] = field(default_factory=dict)

    def __post_init__(self):
        if taken := self.groups.keys() & GROUPS:
            raise ValueError(f"groups of their own can't be called {sorted(taken)}")
        if len(self.scales) == 0:
            raise ValueError("pooling needs at least one scale")

    @property
    def scales(self) -> dict[str, HalfNormal]:
        """The shared scale of each group that has one."""
        every = {f.name: getattr(self, f.name) for f in fields(self) if f.name in GROUPS} | self.groups
        return {group: prior for group, prior in every.items() if prior is not None}


@dataclass(frozen=True)
class Constant:
    prior: Normal | InverseGamma | Fixed


@dataclass(frozen=True)
class Latent:
    components: tuple
    link: str = "identity"

    def __post_init__(self):
        if self.link not in ("identity", "log"):
            raise ValueError("a link is identity or log")


@dataclass(frozen=True)
class SeasonalScale:
    period: int = 4
    prior_sd: float = 0.3

    def __post_init__(self):
        contrasts(self.period)
        _positive(self.prior_sd)


@dataclass(frozen=True)
class Gaussian:
    scale: SeasonalScale | None = None
    family: str = "gaussian"
    tail: str = "upper"


@dataclass(frozen=True)
class GEV:
    tail: str = "upper"
    scale: SeasonalScale | None = None
    family: str = "gev"

    def __post_init__(self):
        if self.tail not in ("upper", "lower"):
            raise ValueError("a tail is upper or lower")


@dataclass(frozen=True)
class Block:
    """A component's matrices.  ``loading[i]`` is a number, or the name of the feature it follows;
    ``noise``: group -> list of columns; ``outputs``: name -> loading; ``mean``, ``cov``: of the state at time zero."""

    names: tuple[str, ...]
    transition: tuple[tuple[float, ...], ...]
    loading: tuple
    noise: dict[str, tuple[tuple[float, ...], ...]]
    amplitude: dict[str, Normal | Fixed]
    outputs: dict[str, tuple]
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]

    def check(self) -> "Block":
        d = len(self.names)
        square = all(len(m) == d and all(len(r) == d for r in m) for m in (self.transition, self.cov))
        vectors = [self.loading, self.mean, *self.outputs.values(), *(c for cols in self.noise.values() for c in cols)]
        if not d or not square or any(len(v) != d for v in vectors):
            raise ValueError(f"block {self.names}: shapes don't fit {d} states")
        if any(not math.isfinite(x) for r in (*self.transition, *self.cov, self.mean) for x in r):
            raise ValueError(f"block {self.names}: numbers must be finite")
        if set(self.noise) != set(self.amplitude):
            raise ValueError(f"block {self.names}: each noise needs an amplitude prior")
        return self


class Component(Protocol):
    """What a component of one's own offers."""

    name: str

    def build(self, priors: Priors) -> Block: ...


def _start(p: Normal | Fixed) -> tuple[float, float]:
    return (float(p.mean), float(p.sd) ** 2) if isinstance(p, Normal) else (float(p.value), 0.0)


def _mode(mode: str, *more: str) -> str:
    if mode not in ("static", "dynamic", *more):
        raise ValueError(f"mode must be static or dynamic, not {mode!r}")
    return mode


@dataclass(frozen=True)
class LocalLevel:
    mode: str = "dynamic"
    name: str = "level"

    def build(self, priors: Priors) -> Block:
        m, v = _start(priors.initial_level)
        moves = _mode(self.mode, "off") == "dynamic"
        noise = {"level": ((1.0,),)} if moves else {}
        return Block((self.name,), ((1.0,),), (1.0,), noise, {"level": priors.level} if moves else {}, {"level": (1.0,)}, (m,), ((v,),)).check()


@dataclass(frozen=True)
class LocalLinearTrend:
    level_mode: str = "dynamic"
    trend_mode: str = "dynamic"
    name: str = "trend"
    mode: str = "dynamic"

    def build(self, priors: Priors) -> Block:
        if _mode(self.trend_mode, "off") == "off":
            return LocalLevel(self.level_mode, self.name).build(priors)
        (m, v), (ms, vs) = _start(priors.initial_level), _start(priors.initial_slope)
        noise = {g: (c,) for g, c, on in (("level", (1.0, 0.0), self.level_mode), ("slope", (0.0, 1.0), self.trend_mode)) if _mode(on) == "dynamic"}
        prefix = "" if self.name == "trend" else f"{self.name}."
        return Block(
            (f"{prefix}level", f"{prefix}slope"), ((1.0, 1.0), (0.0, 1.0)), (1.0, 0.0), noise, {g: getattr(priors, g) for g in noise},
            {f"{prefix}level": (1.0, 0.0), f"{prefix}slope": (0.0, 1.0)}, (m, ms), ((v, 0.0), (0.0, vs)),
        ).check()


@dataclass(frozen=True)
class DummySeasonal:
    period: int = 4
    mode: str = "dynamic"
    name: str = "seasonal"

    def build(self, priors: Priors) -> Block:
        p, d = self.period, self.period - 1
        c = contrasts(p)
        # at time zero the last phase is current, and the ones before it follow
        back = [c[i] for i in range(p - 1, 0, -1)]
        m, v = _start(priors.initial_seasonal)
        if m:
            raise ValueError("initial seasonal effects are centred on zero")
        cov = tuple(tuple(v * sum(a * b for a, b in zip(r, q)) for q in back) for r in back)
        first = tuple([1.0] + [0.0] * (d - 1))
        shift = tuple(tuple(-1.0 if i == 0 else 1.0 if j == i - 1 else 0.0 for j in range(d)) for i in range(d))
        moves = _mode(self.mode, "off") == "dynamic"
        return Block(
            tuple(f"{self.name}[{i}]" for i in range(d)), shift, first, {"seasonal": (first,)} if moves else {}, {"seasonal": priors.seasonal} if moves else {}, {self.name: first}, (0.0,) * d, cov
        ).check()


@dataclass(frozen=True)
class Regression:
    features: tuple[str, ...]
    mode: str = "static"
    name: str = "regression"
    coefficient: Normal | Fixed = Normal(0.0, 10.0)
    amplitude: Normal | Fixed = Normal(0.0, 0.1)

    def build(self, priors: Priors) -> Block:
        k = len(self.features)
        if not k or len(set(self.features)) != k:
            raise ValueError("a regression needs distinct features")
        m, v = _start(self.coefficient)
        unit = [tuple(float(i == j) for j in range(k)) for i in range(k)]
        names = tuple(f"{self.name}.{f}" for f in self.features)
        moves = _mode(self.mode, "off") == "dynamic"
        return Block(
            names, tuple(unit), self.features, {n: (u,) for n, u in zip(names, unit)} if moves else {}, dict.fromkeys(names, self.amplitude) if moves else {},
            {n: u for n, u in zip(names, unit)}, (m,) * k, tuple(tuple(v * x for x in u) for u in unit),
        ).check()


@dataclass(frozen=True)
class Cycle:
    period: float
    damping: float = 1.0
    mode: str = "dynamic"
    name: str = "cycle"
    initial: Normal = Normal(0.0, 1.0)
    amplitude: Normal | Fixed = Normal(0.0, 0.1)

    def build(self, priors: Priors) -> Block:
        if not (self.period > 2 and 0 < self.damping <= 1):
            raise ValueError("a cycle has a period above 2 and a damping in (0, 1]")
        c, s = (self.damping * f(2 * math.pi / self.period) for f in (math.cos, math.sin))
        moves = _mode(self.mode, "off") == "dynamic"
        m, v = _start(self.initial)
        return Block(
            (f"{self.name}.cos", f"{self.name}.sin"), ((c, s), (-s, c)), (1.0, 0.0), {self.name: ((1.0, 0.0), (0.0, 1.0))} if moves else {}, {self.name: self.amplitude} if moves else {},
            {self.name: (1.0, 0.0)}, (m, 0.0), ((v, 0.0), (0.0, v)),
        ).check()


@dataclass(frozen=True)
class Model:
    """``parameters`` may override location (Latent or Constant), scale and shape; what each
    stands for is folded into components and priors."""

    observation: Gaussian | GEV = Gaussian()
    components: tuple = (LocalLinearTrend(),)
    priors: Priors = Priors()
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if set(self.parameters) - {"location", "scale", "shape"}:
            raise ValueError("parameters are location, scale and shape")
        put = lambda k, v: object.__setattr__(self, k, v)
        for name in ("scale", "shape"):
            if isinstance(self.parameters.get(name), Latent):
                raise NotImplementedError(f"a latent {name}")
        location = self.parameters.get("location")
        if isinstance(location, Latent):
            if location.link != "identity":
                raise NotImplementedError("a location with a link")
            put("components", tuple(location.components))
        elif location is not None:
            put("components", (LocalLevel("static"),))
            put("priors", replace(self.priors, initial_level=location.prior if isinstance(location, Constant) else location))
        if (scale := self.parameters.get("scale")) is not None:
            if self.observation.scale is not None:
                raise ValueError("a seasonal scale and a declared scale exclude each other")
            p = scale.prior if isinstance(scale, Constant) else scale
            put("priors", replace(self.priors, variance=Fixed(p.value**2) if isinstance(p, Fixed) else p))
        if (shape := self.parameters.get("shape")) is not None:
            if self.observation.family == "gaussian":
                raise ValueError("a normal observation has no shape")
            put("priors", replace(self.priors, shape=shape.prior if isinstance(shape, Constant) else shape))

    @property
    def period(self) -> int:
        if self.observation.scale is not None:
            return self.observation.scale.period
        return next((c.period for c in self.components if isinstance(c, DummySeasonal) and c.mode != "off"), 1)

    def active(self) -> set[str]:
        return set(compile_model(self).noise)


@dataclass(frozen=True)
class MultiSeriesModel:
    channels: dict[str, Model]
    pooling: Pooling | None = None

    def __post_init__(self):
        if not self.channels or any(not n or "/" in n or "\\" in n for n in self.channels):
            raise ValueError("channels need names without path separators")
        for group in self.pooling.scales if self.pooling else ():
            plans = [compile_model(m) for m in self.channels.values()]
            if not any(isinstance(p.amplitude.get(group), Normal) for p in plans):
                raise ValueError(f"no channel has a free amplitude {group} to pool")


@dataclass(frozen=True)
class Plan:
    """The compiled model: block-diagonal matrices over all states."""

    names: tuple[str, ...]
    transition: tuple[tuple[float, ...], ...]
    loading: tuple
    noise: dict[str, tuple[tuple[float, ...], ...]]
    amplitude: dict[str, Normal | Fixed]
    outputs: dict[str, tuple]
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]
    #: Features that the rows bring, also those whose coefficient is gone.
    declared: tuple[str, ...] | None = None

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(x for x in self.loading if isinstance(x, str)) if self.declared is None else self.declared


def placeholder_features(model: Model, steps: int) -> list[list[float]]:
    """Zeros in the place of a model's features, a row a step; none for a model without."""
    if type(steps) is not int or steps < 1:
        raise ValueError("steps must be an integer of at least 1")
    names = dict.fromkeys(f for c in model.components for f in getattr(c, "features", ()))
    return [[0.0] * len(names) for _ in range(steps)] if names else []


def compile_model(model: Model, prune: bool = True) -> Plan:
    parts = [(c, c.build(model.priors).check()) for c in model.components if getattr(c, "mode", "") != "off"]
    if not parts:
        raise ValueError("all components are off")
    d = sum(len(b.names) for _, b in parts)
    transition, cov = ([[0.0] * d for _ in range(d)] for _ in range(2))
    names, loading, mean, outputs, noise, amplitude = [], [], [], {}, {}, {}
    at = 0
    for c, b in parts:
        k = len(b.names)
        wide = lambda v, at=at, k=k: (0.0,) * at + tuple(v) + (0.0,) * (d - at - k)
        for i in range(k):
            transition[at + i][at : at + k] = b.transition[i]
            cov[at + i][at : at + k] = b.cov[i]
        names += b.names
        loading += b.loading
        mean += b.mean
        own = {n: wide(v) for n, v in b.outputs.items()}
        own.setdefault(c.name, wide(b.loading))
        groups = {g: tuple(map(wide, cols)) for g, cols in b.noise.items() if not (isinstance(b.amplitude[g], Fixed) and b.amplitude[g].value == 0)}
        if set(own) & set(outputs) or set(groups) & set(noise):
            raise ValueError(f"component {c.name}: duplicate output or noise names")
        outputs |= own
        noise |= groups
        amplitude |= {g: b.amplitude[g] for g in groups}
        at += k
    if len(set(names)) != d:
        raise ValueError("duplicate state names")
    tup = lambda m: tuple(map(tuple, m))
    plan = Plan(tuple(names), tup(transition), tuple(loading), noise, amplitude, outputs, tuple(mean), tup(cov))
    return reachable(plan) if prune else plan


def reachable(plan: Plan) -> Plan:
    """The plan without states that stay zero: those outside the span of R, F R, F^2 R, .. for the columns R of every
    noise, of the initial covariance, and of the initial mean.

    A part whose noise is off and whose start is fixed at zero has such states; likelihoods and outputs don't change, and
    filters, whose work grows with the square of the states, get smaller.  A plan of nothing but zeros keeps its first state."""
    d = len(plan.names)
    start = {i for i in range(d) if plan.mean[i] or any(plan.cov[i]) or any(r[i] for cols in plan.noise.values() for r in cols)}
    live, new = set(start), start
    while new:
        new = {i for i in range(d) if any(plan.transition[i][j] for j in new)} - live
        live |= new
    at = sorted(live) or [0]
    if len(at) == d:
        return plan
    some = lambda v: tuple(v[i] for i in at)
    square = lambda m: tuple(some(m[i]) for i in at)
    return Plan(
        some(plan.names), square(plan.transition), some(plan.loading), {g: tuple(map(some, cols)) for g, cols in plan.noise.items()}, plan.amplitude,
        {n: some(v) for n, v in plan.outputs.items()}, some(plan.mean), square(plan.cov), plan.features,
    )
