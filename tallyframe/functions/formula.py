"""Framework formulas as columns.

Formulas are data, so they are untrusted: only + - * /, parentheses, names and numbers are accepted, and the text
itself never reaches SQL. A formula is validated once on the driver and then becomes an ordinary Column.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 500


class FormulaError(ValueError):
    """The text is not an arithmetic formula over names and numbers."""


_JOIN = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}


class Formula:
    """One validated formula: its names, whether it is a plain sum, and its Column."""

    def __init__(self, text: str):
        if not isinstance(text, str) or not text.strip() or len(text) > MAX_LENGTH:
            raise FormulaError(f"a formula is a text of 1 to {MAX_LENGTH} characters")
        try:
            self._root = ast.parse(text.strip(), mode="eval").body
        except SyntaxError:
            raise FormulaError(f"not a formula: {text!r}") from None
        self.text = text
        names: set[str] = set()
        self.additive = self._inspect(self._root, names)
        self.names = tuple(sorted(names))

    def _inspect(self, node: ast.expr, names: set[str]) -> bool:
        match node:
            case ast.Name():
                names.add(node.id)
                return True
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                return False
            case ast.UnaryOp(op=ast.UAdd() | ast.USub()):
                return self._inspect(node.operand, names)
            case ast.BinOp() if type(node.op) in _JOIN:
                sides = [self._inspect(node.left, names), self._inspect(node.right, names)]
                return all(sides) and isinstance(node.op, ast.Add | ast.Sub)
        raise FormulaError(f"only + - * / over names and numbers are allowed: {self.text!r}")

    def column(self, value_of: Callable[[str], Column]) -> Column:
        """The value; null when an input is null or a divisor is zero."""

        def build(node: ast.expr) -> Column:
            match node:
                case ast.Name():
                    return value_of(node.id)
                case ast.Constant():
                    return F.lit(float(node.value))
                case ast.UnaryOp():
                    inner = build(node.operand)
                    return -inner if isinstance(node.op, ast.USub) else inner
            return _JOIN[type(node.op)](build(node.left), build(node.right))

        return build(self._root)


@lru_cache(maxsize=4096)
def formula(text: str) -> Formula:
    return Formula(text)
