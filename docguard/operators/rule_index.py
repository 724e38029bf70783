"""An index over the conditions of large rule tables: sorted bounds per field, a bit set of rules per interval.

One CASE over thousands of rules outgrows a compiled method and tests rules one by one. Here a value is placed among its
field's bounds by binary search; the interval's bit set holds the rules that accept it; the sets of all fields are
combined by AND, and the first bit is the rule that decides. The index depends on the rules alone and is broadcast; it holds
(2 x bounds + 2) x rules bits per field, some 6 MB for 5,000 rules with bounds of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Rows combined at once.
ROWS = 4096
_ORDER = {"gt": np.greater, "gte": np.greater_equal, "lt": np.less, "lte": np.less_equal}


class FieldIndex:
    """Cells of one field: below, at and between its bounds, and NULL as the last."""

    def __init__(self, kind: str, constraints: Sequence[Any], compat: bool):
        self.kind = kind
        if kind == "flag":
            self.bounds = np.array([0.0, 1.0])
        elif kind == "number":
            self.bounds = np.array(sorted({float(b) for c in constraints for b in _bounds(c) if isinstance(b, (int, float))} | {0.0}))
        else:
            self.bounds = np.array(sorted({b for c in constraints for b in _bounds(c) if isinstance(b, str)} | {""}), dtype=object)
        k = len(self.bounds)
        # a value of each cell; where no value lies between two bounds, nothing is ever placed there
        self.samples = np.empty(2 * k + 1, float if kind != "text" else object)
        self.samples[1::2] = self.bounds
        if kind == "text":
            self.samples[0], self.samples[2::2] = "", [b + "\0" for b in self.bounds]
        else:
            self.samples[0], self.samples[2::2] = np.nextafter(self.bounds[0], -np.inf), np.nextafter(self.bounds, np.inf)
        accepted = np.ones((2 * k + 2, len(constraints)), bool)
        for j, c in enumerate(constraints):
            if c is not NO_CONSTRAINT:
                accepted[:-1, j] = self._accepts(c, compat)
                accepted[-1, j] = False
        width = -(-len(constraints) // 64) * 8
        packed = np.zeros((len(accepted), width), np.uint8)
        bits = np.packbits(accepted, axis=1, bitorder="little")
        packed[:, :bits.shape[1]] = bits
        self.sets = packed.view(np.uint64)

    def _accepts(self, constraint: Any, compat: bool) -> np.ndarray:
        """Which cells a constraint accepts, by its test of a value of each."""
        everything = np.ones(len(self.samples), bool)
        if isinstance(constraint, dict):
            pairs = list(constraint.items())
            if compat:
                op, bound = pairs[0]
                return self._compare(op, bound) if op in (*_ORDER, "eq", "in") else everything
            unknown = sorted(set(constraint) - {*_ORDER, "eq", "in"})
            if unknown:
                raise ValueError(f"unknown operator: {unknown}")
            for op, bound in pairs:
                everything &= self._compare(op, bound)
            return everything
        if isinstance(constraint, bool):
            truth = np.array([bool(v) for v in self.samples])
            return truth == constraint
        if isinstance(constraint, (int, float)):
            return ~everything if self.kind == "text" else self.samples == float(constraint)
        if compat:
            return everything
        raise ValueError(f"a condition must be a map, a flag or a number, not {constraint!r}")

    def _compare(self, op: str, bound: Any) -> np.ndarray:
        bounds = list(bound) if op == "in" else [bound]
        own = [b for b in bounds if isinstance(b, str if self.kind == "text" else (int, float))]
        if op in ("in", "eq"):
            return np.isin(self.samples, np.array(own, self.samples.dtype)) if own else np.zeros(len(self.samples), bool)
        if not own:
            raise ValueError(f"{op} cannot compare with {bound!r}")
        return _ORDER[op](self.samples, own[0]).astype(bool)

    def cells(self, values: pd.Series) -> np.ndarray:
        known = values.notna().to_numpy()
        held = values[known]
        held = held.to_numpy(object) if self.kind == "text" else held.to_numpy(float)
        at = np.searchsorted(self.bounds, held)
        exact = self.bounds[np.minimum(at, len(self.bounds) - 1)] == held
        out = np.full(len(values), len(self.sets) - 1)
        out[known] = 2 * at + exact
        return out


#: Stands for a field that a rule says nothing about.
NO_CONSTRAINT = object()


def _bounds(constraint: Any) -> list:
    if isinstance(constraint, dict):
        return [b for op, bound in constraint.items() for b in (bound if op == "in" else [bound])]
    return [] if isinstance(constraint, bool) else [constraint]


class RuleIndex:
    """All rules' conditions; kinds gives the fields that exist and their kind."""

    def __init__(self, conditions: Sequence[dict[str, Any]], kinds: dict[str, str], compat: bool = False):
        self.size = len(conditions)
        live = np.array([all(f in kinds for f in c) for c in conditions], bool)
        self.fields = {name: FieldIndex(kind, [c.get(name, NO_CONSTRAINT) if ok else NO_CONSTRAINT for c, ok in zip(conditions, live)], compat)
                       for name, kind in kinds.items() if any(name in c and ok for c, ok in zip(conditions, live))}
        start = np.zeros(-(-self.size // 64) * 8, np.uint8)
        bits = np.packbits(live, bitorder="little")
        start[:len(bits)] = bits
        self.live = start.view(np.uint64)

    def sets(self, columns: dict[str, pd.Series], n: int):
        """The rules that hold, as bit sets, for blocks of rows."""
        cells = {name: self.fields[name].cells(values) for name, values in columns.items()}
        for at in range(0, n, ROWS):
            held = np.repeat(self.live[None], min(ROWS, n - at), axis=0)
            for name, cell in cells.items():
                held &= self.fields[name].sets[cell[at:at + ROWS]]
            yield held

    def first(self, columns: dict[str, pd.Series], n: int) -> np.ndarray:
        """Place of the first rule that holds, the number of rules where none does."""
        out = [np.zeros(0, np.int32)]
        for held in self.sets(columns, n):
            some = held != 0
            word = some.argmax(1) if held.shape[1] else np.zeros(len(held), int)
            low = held[np.arange(len(held)), word] if held.shape[1] else np.zeros(len(held), np.uint64)
            low &= ~low + np.uint64(1)
            bit = np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(int)
            out.append(np.where(low > 0, 64 * word + bit, self.size).astype(np.int32))
        return np.concatenate(out)

    def all(self, columns: dict[str, pd.Series], n: int) -> list[np.ndarray]:
        """Places of all rules that hold, per row."""
        out = []
        for held in self.sets(columns, n):
            bits = np.unpackbits(held.view(np.uint8), axis=1, bitorder="little")[:, :self.size]
            rows, places = np.nonzero(bits)
            out += np.split(places.astype(np.int32), np.searchsorted(rows, np.arange(1, len(bits))))
        return out


def placing_udf(spark: SparkSession, index: RuleIndex, every: bool = False):
    """(column, fields): the first place, or all places, as a function of the columns ctx_<field> of these fields."""
    shared, fields = spark.sparkContext.broadcast(index), list(index.fields)

    @F.pandas_udf("array<int>" if every else "int")
    def place(*columns: pd.Series) -> pd.Series:
        own = shared.value
        named = dict(zip(fields, columns[1:]))
        return pd.Series(own.all(named, len(columns[0])) if every else own.first(named, len(columns[0])))

    return place(F.lit(1), *[F.col(f"ctx_{f}") for f in fields])
