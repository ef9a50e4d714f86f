"""Arithmetic over batches of rows: expressions worked out with numpy inside tasks, as Spark works them out, and their real roots."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping, Sequence

import numpy as np

#: A value for each row, and where it is null. Null and not-a-number differ: `min` and `max` skip nulls alone.
Value = tuple[np.ndarray, np.ndarray]

_PLAIN = {
    "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh,
    "exp": np.exp, "abs": np.abs, "degrees": np.degrees, "radians": np.radians,
}
_LOGS = {"log": np.log, "ln": np.log, "log10": np.log10, "log2": np.log2}
#: Rows that are worked out at once.
ROWS = 512


def _round(v: np.ndarray) -> np.ndarray:
    whole = np.trunc(v)
    return np.where(np.isfinite(v), whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0), v)


def _whole(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda v: np.nan_to_num(np.clip(of(v), -(2.0**63), 2.0**63), nan=0.0)


_PLAIN |= {"round": _round, "ceil": _whole(np.ceil), "floor": _whole(np.floor)}


def _extreme(values: Sequence[Value], least: bool) -> Value:
    """Spark's least and greatest: nulls don't count, not-a-number is above all."""
    out, null = values[0]
    for v, n in values[1:]:
        both = np.fmin(out, v) if least else np.maximum(out, v)
        out, null = np.where(null, v, np.where(n, out, both)), null & n
    return out, null


def evaluator(expression: str, constants: Mapping[str, float]) -> Callable[[Mapping[str, np.ndarray]], np.ndarray]:
    """f(values by name) of an expression that `lookup.compiled` allows: not-a-number where it has no finite value."""
    tree = ast.parse(expression, mode="eval").body

    def work(node: ast.AST, values: Mapping[str, np.ndarray]) -> Value:
        match node:
            case ast.Constant(value=value):
                return np.float64(value), np.False_
            case ast.Name(id=name):
                return (values[name] if name in values else np.float64(constants[name])), np.False_
            case ast.UnaryOp(op=op, operand=x):
                v, n = work(x, values)
                return (-v if isinstance(op, ast.USub) else v), n
            case ast.BinOp(left=a, op=op, right=b):
                (v, n), (w, m) = work(a, values), work(b, values)
                match op:
                    case ast.Add():
                        return v + w, n | m
                    case ast.Sub():
                        return v - w, n | m
                    case ast.Mult():
                        return v * w, n | m
                    case ast.Div():
                        return v / w, n | m | (w == 0)
                    case ast.Mod():
                        return np.fmod(v, w), n | m | (w == 0)
                return np.power(v, w), n | m
            case ast.Call(func=ast.Name(id=name), args=args):
                told = [work(a, values) for a in args]
                if name in ("min", "max"):
                    return _extreme(told, name == "min")
                if name == "pow":
                    return np.power(told[0][0], told[1][0]), told[0][1] | told[1][1]
                v, n = told[0]
                return (_LOGS[name](v), n | (v <= 0)) if name in _LOGS else (_PLAIN[name](v), n)
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    def f(values: Mapping[str, np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            v, n = work(tree, values)
            return np.where(n | ~np.isfinite(v), np.nan, v)

    return f


def real_roots(f: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int, places: np.ndarray, halvings: int) -> list[np.ndarray | None]:
    """Roots of f(x, row numbers) for each of `count` rows, sorted; None where f is zero or undefined at all places.

    All places of ROWS rows are worked out at once, and the brackets of these rows are halved together.
    """
    out: list[np.ndarray | None] = []
    for start in range(0, count, ROWS):
        rows = np.arange(start, min(start + ROWS, count))
        y = np.broadcast_to(f(places[None, :], rows[:, None]), (len(rows), len(places)))
        sign, size = np.sign(y), np.abs(y)
        zero = y == 0
        crosses = np.zeros_like(zero)
        crosses[:, :-1] = sign[:, :-1] * sign[:, 1:] < 0
        before, here, after = size[:, :-2], size[:, 1:-1], size[:, 2:]
        touches = np.zeros_like(zero)
        touches[:, 1:-1] = (sign[:, :-2] == sign[:, 1:-1]) & (sign[:, 2:] == sign[:, 1:-1]) & (here <= np.minimum(before, after)) & (here < np.maximum(before, after))
        touches &= ~zero & ~crosses
        r0, i0 = np.nonzero(zero)
        r1, i1 = np.nonzero(crosses)
        r2, i2 = np.nonzero(touches)
        lo, hi = places[i1], places[i1 + 1]
        for _ in range(halvings):
            middle = (lo + hi) / 2
            left = np.sign(f(middle, rows[r1])) == sign[r1, i1]
            lo, hi = np.where(left, middle, lo), np.where(left, hi, middle)
        crossing, scale = (lo + hi) / 2, np.maximum(size[r1, i1], size[r1, i1 + 1])
        good = np.abs(f(crossing, rows[r1])) <= 1e-6 * scale
        lo, hi = places[i2 - 1], places[i2 + 1]
        for _ in range(halvings):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            less = np.abs(f(a, rows[r2])) <= np.abs(f(b, rows[r2]))
            lo, hi = np.where(less, lo, a), np.where(less, b, hi)
        turning, scale = (lo + hi) / 2, np.maximum(size[r2, i2 - 1], size[r2, i2 + 1])
        fine = np.abs(f(turning, rows[r2])) <= 1e-12 * scale
        found = np.concatenate([crossing[good], turning[fine]])
        found = np.concatenate([places[i0], np.where(np.abs(found) < 1e-12, 0.0, found)])
        owner = np.concatenate([r0, r1[good], r2[fine]])
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        apart = np.ones(len(found), bool)
        apart[1:] = (owner[1:] != owner[:-1]) | (found[1:] - found[:-1] > 1e-7 * np.maximum(np.abs(found[1:]), 1))
        found, owner = found[apart], owner[apart]
        told = (size > 0).any(1)
        parts = np.split(found, np.searchsorted(owner, np.arange(1, len(rows))))
        out.extend(p if t else None for p, t in zip(parts, told))
    return out
