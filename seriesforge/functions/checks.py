"""Checks of parameters before a plan is built.

    @parameters(n_states=whole(1, 50), penalty=number(0), method=one_of("pelt", "binseg", "cusum"))
    def detect(series, n_states, penalty, method): ...

A check takes a name and a value and raises ParameterError, a ValueError, that
names both. Parameters without a check, and those left to a default of None,
pass.
"""

from __future__ import annotations

import functools
import inspect
import math
import numbers
from collections.abc import Callable

Check = Callable[[str, object], None]


class ParameterError(ValueError):
    """A parameter that is of the wrong kind or out of its range."""


def _within(name: str, value: float, lo: float | None, hi: float | None) -> None:
    if lo is not None and value < lo or hi is not None and value > hi:
        raise ParameterError(f"{name} = {value} is not in [{'-inf' if lo is None else lo}, {'inf' if hi is None else hi}]")


def whole(lo: int | None = None, hi: int | None = None) -> Check:
    def check(name: str, value: object) -> None:
        if not isinstance(value, numbers.Integral) or isinstance(value, bool):
            raise ParameterError(f"{name} = {value!r} is no whole number")
        _within(name, int(value), lo, hi)

    return check


def number(lo: float | None = None, hi: float | None = None, infinite: bool = False) -> Check:
    def check(name: str, value: object) -> None:
        if not isinstance(value, numbers.Real) or isinstance(value, bool) or math.isnan(value):
            raise ParameterError(f"{name} = {value!r} is no number")
        if math.isinf(value) and not infinite:
            raise ParameterError(f"{name} is infinite")
        _within(name, float(value), lo, hi)

    return check


def probability() -> Check:
    return number(0.0, 1.0)


def one_of(*choices: object) -> Check:
    def check(name: str, value: object) -> None:
        if value not in choices:
            raise ParameterError(f"{name} = {value!r} is none of {', '.join(map(repr, choices))}")

    return check


def parameters(**checks: Check) -> Callable[[Callable], Callable]:
    """Checks a function's arguments, defaults included, each time it is called."""

    def around(f: Callable) -> Callable:
        known = inspect.signature(f)
        unknown = set(checks) - set(known.parameters)
        if unknown:
            raise TypeError(f"{f.__name__} has no parameter {', '.join(sorted(unknown))}")

        @functools.wraps(f)
        def call(*args, **kwargs):
            bound = known.bind(*args, **kwargs)
            bound.apply_defaults()
            for name, check in checks.items():
                value = bound.arguments[name]
                if value is not None or known.parameters[name].default is not None:
                    check(name, value)
            return f(*args, **kwargs)

        return call

    return around
