"""Arithmetic in text: a total evaluator of plain expressions, and their extraction from replies."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The limits of an expression.
MAX_LENGTH, MAX_EXPONENT, MAX_BASE = 200, 100, 1e6
#: Fixed value: a comma that groups thousands.
_GROUPS = re.compile(r",(?=\d{3}(?:\D|$))")
_BINARY = {"Add": operator.add, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "FloorDiv": operator.floordiv, "Mod": operator.mod, "Pow": operator.pow}
_CALLS = {"abs": abs, "round": round, "min": min, "max": max}


def value_of(expr: str | None) -> tuple[float | None, str | None]:
    """(value, error) of an expression of numbers, ``+ - * / // % **``, abs, round, min and max. Never raises.

    A comma before three digits is a thousands separator. Null and blank
    expressions are errors, as are divisions by zero, overflow and results that
    are no real number.
    """
    expr = _GROUPS.sub("", (expr or "").strip())
    if not expr:
        return None, "empty"
    if len(expr) > MAX_LENGTH:
        return None, "too long"
    try:
        todo = [ast.parse(expr, mode="eval").body]
        order: list[ast.expr] = []
        while todo:  # operands after their operators, so that the reverse order can be evaluated without recursion
            node = todo.pop()
            order.append(node)
            if isinstance(node, ast.BinOp):
                todo += [node.left, node.right]
            elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
                todo.append(node.operand)
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
                todo += node.args
            elif not (isinstance(node, ast.Constant) and type(node.value) in (int, float)):
                return None, "not arithmetic"
        done: dict[int, float] = {}
        for node in reversed(order):
            if isinstance(node, ast.Constant):
                out = node.value
            elif isinstance(node, ast.UnaryOp):
                out = -done[id(node.operand)] if isinstance(node.op, ast.USub) else done[id(node.operand)]
            elif isinstance(node, ast.Call):
                out = _CALLS[node.func.id](*[done[id(a)] for a in node.args])
            else:
                kind, a, b = type(node.op).__name__, done[id(node.left)], done[id(node.right)]
                if kind not in _BINARY:
                    return None, "not arithmetic"
                if kind == "Pow" and (abs(b) > MAX_EXPONENT or abs(a) > MAX_BASE):
                    return None, "exponent too large"
                out = _BINARY[kind](a, b)
            if isinstance(out, complex):
                return None, "not real"
            done[id(node)] = out
        return float(done[id(order[0])]), None
    except ZeroDivisionError:
        return None, "division by zero"
    except OverflowError:
        return None, "overflow"
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        return None, "not arithmetic"


#: A number, a name, a doubled operator, or one other character that is not a space.
_PIECE = re.compile(r"(?P<number>[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|//|[-+*/%])|(?P<mark>[(),])|\S")


def _spans(reply: str) -> list[list[re.Match]]:
    """Runs of pieces that could be arithmetic: any other word or sign ends a run."""
    runs: list[list[re.Match]] = [[]]
    for piece in _PIECE.finditer(reply):
        if piece["number"] or piece["op"] or piece["mark"] or (piece["name"] or "").lower() in _CALLS:
            runs[-1].append(piece)
        else:
            runs.append([])
    return [r for r in runs if r]


def _binary(run: list[re.Match]) -> bool:
    """Whether an operator stands between two operands."""
    return any(m["op"] and k and (run[k - 1]["number"] or run[k - 1][0] == ")") for k, m in enumerate(run[:-1]))


def expression_in(reply: str | None) -> str | None:
    """The longest stretch of a reply that has a value and an operator between operands; the first of equals.

    A reply that begins with NONE has none. Signs at the ends of a stretch
    (dashes, closing commas) may be cut off to give it a value.
    """
    reply = (reply or "").strip()
    if reply[:4].upper() == "NONE":
        return None
    best = ""
    for run in _spans(reply):
        for first in range(len(run)):
            if run[-1].end() - run[first].start() <= len(best):
                break  # none that begins here or later is longer
            if run[first]["op"] in ("*", "/", "%", "**", "//") or run[first][0] in ("),"):
                continue
            for last in range(len(run), first + 2, -1):
                text = reply[run[first].start() : run[last - 1].end()]
                if len(text) <= len(best):
                    break
                if len(text) <= MAX_LENGTH and _binary(run[first:last]) and value_of(text)[1] is None:
                    best = text
                    break
    return best or None


def evaluate(expr: Column | str) -> Column:
    """struct(value, error) of each expression, in Arrow batches."""

    @F.pandas_udf("value double, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([value_of(x) for x in s], columns=["value", "error"])

    return run(expr)


def extracted(reply: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(expression_in, na_action=None)

    return run(reply)
