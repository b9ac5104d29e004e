"""Rule expressions as columns: features, numbers, + and *, and a closed set of functions, compiled from Python syntax without evaluating it."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparators of the rule language, fixed values.
COMPARATORS: dict[str, Callable] = {"GT": operator.gt, "GE": operator.ge, "LT": operator.lt, "LE": operator.le, "EQ": operator.eq}


def protected_div(x: Column, y: Column) -> Column:
    """x / y, where a y within 1e-6 of 0 counts as 1e-6 if it is 0, 2e-6 if above; below, the quotient is infinite (nan for 0 / 0)."""
    x, y = x.cast("double"), y.cast("double")
    near = F.abs(y) < 1e-6
    infinite = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
    return F.when(near & (y < 0), infinite).otherwise(F.try_divide(x, F.when(near, F.signum(y) * 1e-6 + 1e-6).otherwise(y)))


def to_bool(x: Column) -> Column:
    """Whether x is neither 0 nor nan nor null."""
    x = x.cast("double")
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


class _Compiler(ast.NodeVisitor):
    """Every visit gives (column, whether it is boolean). Sums of booleans are OR, products AND."""

    def __init__(self, names: Iterable[str]):
        self.names = set(names)

    def generic_visit(self, node: ast.AST):
        raise ValueError(f"{type(node).__name__} has no place in a rule")

    def visit_Expression(self, node: ast.Expression):
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant):
        if isinstance(node.value, bool):
            return F.lit(node.value), True
        if not isinstance(node.value, (int, float)):
            raise ValueError("only numbers are constants")
        return F.lit(float(node.value)), False

    def visit_Name(self, node: ast.Name):
        if node.id not in self.names:
            raise KeyError(f"no feature {node.id}")
        return F.col(f"`{node.id}`").cast("double"), False

    def visit_UnaryOp(self, node: ast.UnaryOp):
        x, is_bool = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -self._number(x, is_bool), False
        if isinstance(node.op, ast.UAdd):
            return self._number(x, is_bool), False
        return self.generic_visit(node)

    def visit_BinOp(self, node: ast.BinOp):
        (a, a_bool), (b, b_bool) = self.visit(node.left), self.visit(node.right)
        if not isinstance(node.op, (ast.Add, ast.Mult)):
            return self.generic_visit(node.op)
        if a_bool and b_bool:
            return (a | b if isinstance(node.op, ast.Add) else a & b), True
        a, b = self._number(a, a_bool), self._number(b, b_bool)
        return (a + b if isinstance(node.op, ast.Add) else a * b), False

    def visit_Call(self, node: ast.Call):
        name = node.func.id if isinstance(node.func, ast.Name) else ""
        args = [self.visit(x) for x in node.args]
        if node.keywords or len(args) != (1 if name == "tanh" else 2):
            raise ValueError(f"{name or 'a call'} takes other arguments")
        if name in ("AND", "OR"):
            a, b = (x if is_bool else to_bool(x) for x, is_bool in args)
            return (a & b if name == "AND" else a | b), True
        numbers = [self._number(*x) for x in args]
        if name == "tanh":
            return F.tanh(numbers[0]), False
        if name == "div":
            return protected_div(*numbers), False
        if name in COMPARATORS:
            a, b = numbers
            return F.coalesce(COMPARATORS[name](a, b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False)), True
        raise ValueError(f"no function {name}")

    @staticmethod
    def _number(x: Column, is_bool: bool) -> Column:
        return x.cast("double") if is_bool else x


def compiled(expression: str, names: Iterable[str]) -> Column:
    """The expression's raw value as a double; nan and null count as 0."""
    value, is_bool = _Compiler(names).visit(ast.parse(expression, mode="eval"))
    value = value.cast("double") if is_bool else value
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def with_signal(features: DataFrame, expression: str, out: str = "signal", key: str = "symbol", names: Iterable[str] | None = None) -> DataFrame:
    """features with the rule's bounded value: over the key's deviation, if that is finite and above 1e-6, through tanh."""
    names = [c for c in features.columns if c not in (key, "ts")] if names is None else names
    df = features.withColumn(out, compiled(expression, names))
    spread = df.groupBy(key).agg(F.stddev_pop(out).alias("__s"))  # a row for each key
    usable = F.col("__s").isNotNull() & ~F.isnan("__s") & (F.col("__s") < float("inf")) & (F.col("__s") > 1e-6)
    return df.join(spread, key).withColumn(out, F.tanh(F.col(out) / F.when(usable, F.col("__s")).otherwise(1.0))).drop("__s")


def tokens(expression: Column) -> Column:
    """The distinct identifiers of an expression, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(expression, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)))


