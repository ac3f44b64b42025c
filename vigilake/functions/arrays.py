"""Array helpers that stay inside Spark expressions.

Longer expressions are written as SQL text: one call to the JVM instead of a thousand small ones per plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 256


def empty_array(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def constant_array(values, kind: str = "string") -> Column:
    """An array of constants in one call; the optimizer folds it to a literal."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``.

    Branches of CASE and lambda bodies are not covered by Spark's common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(value: str) -> str:
    """A text as SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(name: str, value: str, body: str) -> str:
    """SQL form of :func:`let`."""
    return f"transform(array({value}), {name} -> {body})[0]"


_OPERATIONS = {"sum": "{0} + {1}", "max": "greatest({0}, {1})"}


def running_sql(values: str, operation: str) -> str:
    """Running sum or maximum over an ``array<int>`` of any length, as SQL text.

    Long arrays are done in blocks of 256, then each block takes in the result of the blocks before it. A text with
    very many matches so costs time in proportion to its matches and not to their square.
    """
    op = _OPERATIONS[operation]

    def cumulate(array: str) -> str:
        step = op.format("coalesce(get(acc, size(acc) - 1), 0)", "x")
        return f"aggregate({array}, cast(array() as array<int>), (acc, x) -> concat(acc, array({step})))"

    blocks = (
        f"transform(sequence(0, cast(ceil(size(v) / {_BLOCK}) as int) - 1), b -> "
        + cumulate(f"slice(v, b * {_BLOCK} + 1, {_BLOCK})") + ")"
    )
    before = f"concat(array(0), slice({cumulate('transform(done, t -> element_at(t, -1))')}, 1, size(done) - 1))"
    shifted = let_sql(
        "done", blocks, f"flatten(zip_with(done, {before}, (t, e) -> transform(t, y -> {op.format('y', 'e')})))"
    )
    return let_sql("v", values, f"if(size(v) <= {_BLOCK}, {cumulate('v')}, {shifted})")


def running_totals(values: str) -> Column:
    """Running sums of an array given as SQL text or column name."""
    return F.expr(running_sql(values, "sum"))
