"""SQL fragments.

Wide expressions are assembled as SQL text and handed to Spark in one call. Building them call by call
from Python costs seconds of driver time for a few thousand nodes; the resulting plan is the same.
Fragments take and return SQL text; a column name is SQL text too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


def lit(value: str | int | float | bool | bytes | None) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def lits(values: Iterable[str]) -> str:
    """Comma-separated literals."""
    return ", ".join(lit(v) for v in values)


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once.

    Catalyst does not share sub-expressions inside higher-order functions, so a value that is used
    several times is bound as a lambda variable.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def once(df: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with the fragment ``value`` as column ``name``, in a form that the optimizer does not copy.

    Filters and generators above a projection are pushed below it by copying the projected expression; for
    a wide one that doubles the work, and along a chain of them the plan grows without bound. The result of
    a generator is never copied, while filters on the other columns pass it and reach the scan.
    """
    from pyspark.sql import functions as F

    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(F.expr(value))).alias(name))


def opaque(value: str) -> str:
    """``value`` as an expression that is not copied: for arrays that are exploded next.

    Spark 4.1 loses nested columns where a generator stands on another one, so :func:`once` cannot be used
    there. No filter passes such a projection.
    """
    return f"IF(rand(0) + 1D > 0D, {value}, NULL)"


def when(cases: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    """``CASE`` over condition and value fragments."""
    arms = " ".join(f"WHEN {condition} THEN {value}" for condition, value in cases)
    return f"CASE {arms} ELSE {otherwise} END" if arms else otherwise


def lookup(key: str, table: Mapping[str, str], otherwise: str) -> str:
    """Literal lookup of ``key``."""
    return when([(f"{key} = {lit(k)}", lit(v)) for k, v in table.items()], otherwise)


def struct(**fields: str) -> str:
    """``named_struct`` of fragments."""
    return "named_struct(" + ", ".join(f"{lit(name)}, {value}" for name, value in fields.items()) + ")"


#: Elements of an array that a fold takes at a time.
CELL = 128


def cells(values: str) -> str:
    """The array ``values`` (a bound name) cut into arrays of :data:`CELL` elements."""
    cut = f"transform(sequence(0, (size({values}) - 1) div {CELL}), cell -> slice({values}, cell * {CELL} + 1, {CELL}))"
    return f"IF(size({values}) = 0, array(), {cut})"


def scan(values: str, start: str, step: Callable[[str, str], str], kind: str) -> str:
    """The array of states after each element, from ``start``; ``step`` takes a state and an element.

    A fold copies its whole state at each step, with all that was appended to it. So a first fold keeps only the
    state before each cell, and a second one walks every cell from there: an array of n elements costs n * CELL
    copies and (n / CELL) squared. States are of the type ``kind``.
    """
    none = f"cast(array() AS array<{kind}>)"
    end = f"aggregate(cell, outer.at, (at, x) -> {step('at', 'x')})"
    starts = (
        f"aggregate(parts, named_struct('at', cast({start} AS {kind}), 'done', {none}), "
        f"(outer, cell) -> named_struct('at', {end}, 'done', concat(outer.done, array(outer.at))), outer -> outer.done)"
    )
    grown = "named_struct('at', new, 'done', concat(acc.done, array(new)))"
    inner = (
        f"aggregate(cell, named_struct('at', begin, 'done', {none}), "
        f"(acc, x) -> {let('new', step('acc.at', 'x'), grown)}, acc -> acc.done)"
    )
    walked = f"flatten(zip_with(parts, {starts}, (cell, begin) -> {inner}))"
    return let("vals", values, let("parts", cells("vals"), f"IF(size(vals) = 0, {none}, {walked})"))


def prefix_sums(values: str) -> str:
    """Sums of the whole numbers of an array up to and with each."""
    return scan(values, "0", lambda state, x: f"cast({state} + {x} AS int)", "int")


def prefix_maxima(values: str) -> str:
    """The largest of the whole numbers of an array up to and with each."""
    return scan(values, "-1", lambda state, x: f"greatest({state}, {x})", "int")
