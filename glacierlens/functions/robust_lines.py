"""Robust straight lines by iteratively reweighted least squares, as column expressions.

A series is one array of points, as it has a value for each month or window of the
record at most.  The iteration is a fold over its rounds: the state holds the line,
the scale's last deviance and whether the series has converged, and a converged
state passes through unchanged.  All series are fitted at once, without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glacierlens.operators.series import array_median

# fixed values: tuning constants, iteration limits
BISQUARE_TUNE = 4.685
HUBER_TUNE = 1.345
MAD_NORMAL = 0.6744897501960817
MAX_ITER = 50
# relative change of both coefficients, and change of the deviance, that end the rounds
SAME_LINE = 1.5e-8
SAME_DEVIANCE = 1e-8
# step of the derivative of the pseudo-values
STEP = 1e-4
# parameters of a line
P = 2


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(points: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + of(p))


def weighted_line(points: Column, weight: Callable[[Column], Column]) -> Column:
    """Struct ``a, b`` of the line a + b x through points ``x, y``, centred before the products are summed."""
    held = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), weight(p).alias("w")))

    def slope(q: Column, c: Column) -> Column:
        sxx = total(q, lambda p: p["w"] * (p["x"] - c["x"]) * (p["x"] - c["x"]))
        sxy = total(q, lambda p: p["w"] * (p["x"] - c["x"]) * (p["y"] - c["y"]))
        return let(F.try_divide(sxy, sxx), lambda b: F.struct((c["y"] - b * c["x"]).alias("a"), b.alias("b")))

    def centred(q: Column) -> Column:
        w = total(q, lambda p: p["w"])
        centre = let(w, lambda w: F.struct(F.try_divide(total(q, lambda p: p["w"] * p["x"]), w).alias("x"), F.try_divide(total(q, lambda p: p["w"] * p["y"]), w).alias("y")))
        return let(centre, lambda c: slope(q, c))

    return let(held, centred)


def _rounds(step: Callable[[Column], Column], start: Column) -> Column:
    """The state after all rounds; ``start`` has the first line ``a, b``."""
    first = F.struct(start["a"].alias("a"), start["b"].alias("b"), F.lit(None).cast("double").alias("last"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ITER)), first, lambda st, _: F.when(st["done"], st).otherwise(step(st)))


def _state(line: Column, last: Column, done: Column) -> Column:
    return F.struct(line["a"].alias("a"), line["b"].alias("b"), last.cast("double").alias("last"), F.coalesce(done, F.lit(False)).alias("done"))


def _changed(new: Column, old: Column) -> Column:
    return F.abs(new - old) / F.greatest(F.abs(new), F.abs(old), F.lit(1e-300))


def bisquare_weight(u: Column) -> Column:
    return F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(F.lit(0.0))


def with_leverage(points: Column) -> Column:
    """Points with ``h`` and the factor ``adj`` of their residuals, 1 / sqrt(1 - h)."""
    n = F.size(points)

    def placed(mx: Column) -> Column:
        def lever(sxx: Column) -> Column:
            h = lambda p: F.least(1 / n + (p["x"] - mx) * (p["x"] - mx) / sxx, F.lit(0.9999))
            return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), h(p).alias("h"), (1 / F.sqrt(1 - h(p))).alias("adj")))

        return let(total(points, lambda p: (p["x"] - mx) * (p["x"] - mx)), lever)

    return let(total(points, lambda p: p["x"]) / n, placed)


def _residuals(points: Column, line: Column, adjusted: bool) -> Column:
    r = lambda p: p["y"] - line["a"] - line["b"] * p["x"]
    return F.transform(points, lambda p: r(p) * p["adj"] if adjusted else r(p))


def bisquare_scale(points: Column, line: Column, tiny: Column) -> Column:
    """Median absolute residual without the smallest one, in standard deviations; at least ``tiny``."""
    size = F.transform(_residuals(points, line, True), F.abs)
    spread = array_median(F.slice(F.array_sort(size), F.lit(P), F.size(points) - (P - 1))) / 0.6745
    return F.greatest(spread, tiny)


def bisquare_line(points: Column, tiny: Column) -> Column:
    """Line of points with leverage (Holland & Welsch 1977)."""

    def step(st: Column) -> Column:
        def weighted(s: Column) -> Column:
            weight = lambda p: bisquare_weight((p["y"] - st["a"] - st["b"] * p["x"]) * p["adj"] / (s * BISQUARE_TUNE))
            held = F.size(F.filter(points, lambda p: weight(p) > 0))
            stop = _state(st, st["last"], F.lit(True))

            def next_(line: Column) -> Column:
                change = F.greatest(_changed(line["a"], st["a"]), _changed(line["b"], st["b"]))
                return _state(line, st["last"], change <= SAME_LINE)

            return F.when(held < P, stop).otherwise(let(weighted_line(points, weight), next_))

        return let(bisquare_scale(points, st, tiny), weighted)

    return let(weighted_line(points, lambda p: F.lit(1.0)), lambda start: _rounds(step, start))


def bisquare_sigma(points: Column, line: Column, tiny: Column, ols: Column) -> Column:
    """Standard deviation by the pseudo-values of Street, Carroll & Ruppert (1988), drawn towards the plain one."""
    n = F.size(points)

    def pseudo(st: Column) -> Column:
        u = lambda p: (p["y"] - line["a"] - line["b"] * p["x"]) * p["adj"] / st
        psi = lambda v: v * bisquare_weight(v)
        m1 = total(points, lambda p: (psi(u(p) + STEP) - psi(u(p) - STEP)) / (2 * STEP)) / n
        m2 = total(points, lambda p: (1 - p["h"]) * psi(u(p)) * psi(u(p))) / (n - P)

        def drawn(m: Column) -> Column:
            robust = F.when(m["m1"] > 0, (1 + P / n * (1 - m["m1"]) / m["m1"]) * F.sqrt(m["m2"]) * st / m["m1"]).otherwise(ols)
            return let(robust, lambda r: F.greatest(r, F.sqrt((ols * ols * P * P + r * r * n) / (P * P + n))))

        return let(F.struct(m1.alias("m1"), m2.alias("m2")), drawn)

    return let(bisquare_scale(points, line, tiny) * BISQUARE_TUNE, pseudo)


def huber_scale(points: Column, line: Column) -> Column:
    return array_median(F.transform(_residuals(points, line, False), F.abs)) / MAD_NORMAL


def huber_line(points: Column) -> Column:
    """Line with Huber's weights (1981); the rounds end when the deviance stays, or nothing is left over."""

    def step(st: Column) -> Column:
        def weighted(s: Column) -> Column:
            u = lambda p: F.abs(p["y"] - st["a"] - st["b"] * p["x"]) / s
            weight = lambda p: F.when(u(p) <= HUBER_TUNE, F.lit(1.0)).otherwise(HUBER_TUNE / u(p))

            def scaled(line: Column) -> Column:
                def next_(s1: Column) -> Column:
                    z = lambda p: F.abs(p["y"] - line["a"] - line["b"] * p["x"]) / s1
                    cost = lambda v: F.when(v <= HUBER_TUNE, v * v / 2).otherwise(HUBER_TUNE * v - HUBER_TUNE**2 / 2)
                    deviance = total(points, lambda p: cost(z(p)))
                    settled = let(deviance, lambda d: _state(line, d, F.abs(d - st["last"]) <= SAME_DEVIANCE))
                    return F.when(s1 <= 0, _state(line, st["last"], F.lit(True))).otherwise(settled)

                return let(huber_scale(points, line), next_)

            return F.when(s <= 0, _state(st, st["last"], F.lit(True))).otherwise(let(weighted_line(points, weight), scaled))

        return let(huber_scale(points, st), weighted)

    return let(weighted_line(points, lambda p: F.lit(1.0)), lambda start: _rounds(step, start))


def huber_error(points: Column, line: Column, sxx: Column) -> Column:
    """Standard error of the slope; 0 where no residual is left."""
    n = F.size(points)

    def spread(s: Column) -> Column:
        z = lambda p: (p["y"] - line["a"] - line["b"] * p["x"]) / s
        inner = total(points, lambda p: F.when(F.abs(z(p)) <= HUBER_TUNE, F.lit(1.0)).otherwise(0.0)) / n
        bounded = lambda p: F.least(F.greatest(z(p), F.lit(-HUBER_TUNE)), F.lit(HUBER_TUNE))
        squares = total(points, lambda p: bounded(p) * bounded(p))

        def error(m: Column) -> Column:
            k = 1 + P / n * (m * (1 - m)) / (m * m)
            return F.sqrt(k * k * squares * s * s / (n - P) / (m * m) / sxx)

        return F.when(s <= 0, F.lit(0.0)).otherwise(let(inner, error))

    return let(huber_scale(points, line), spread)
