"""Typed payload filters: a strict request grammar, canonical numbers, and evaluation over JSON payloads."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits of the filter grammar.
NAMES, ALTERNATIVES, STRING, DIGITS, TOKEN, EXPONENT, CANONICAL = 8, 64, 512, 40, 256, 200, 32 * 1024
_NUMBER = re.compile(r"(-?)(0|[1-9]\d*)(?:\.(\d+))?(?:[eE]([+-]?\d+))?\Z")


class FilterError(ValueError):
    pass


class Number(str):
    """The source text of a JSON number."""


def canonical(token: str) -> str | None:
    """A number's plain decimal form; None beyond the limits."""
    m = _NUMBER.match(token)
    if not m or len(token) > TOKEN:
        return None
    sign, whole, part, power = m[1], m[2], m[3] or "", int(m[4] or 0)
    digits = (whole + part).lstrip("0")
    shift = power - len(part)
    while digits.endswith("0"):
        digits, shift = digits[:-1], shift + 1
    if not digits:
        return "0"
    if len(digits) > DIGITS or abs(shift + len(digits) - 1) > EXPONENT:
        return None
    if shift >= 0:
        return sign + digits + "0" * shift
    digits = digits.rjust(1 - shift, "0")
    return f"{sign}{digits[:shift]}.{digits[shift:]}"


class _Pairs(list):
    pass


def load(text: str):
    """Strict JSON: repeated names and the digits of numbers stay."""

    def refuse(x: str):
        raise ValueError(x)

    return json.loads(text, object_pairs_hook=_Pairs, parse_int=Number, parse_float=Number, parse_constant=refuse)


def _scalar(name: str, x) -> tuple[int, object]:
    if isinstance(x, bool):
        return (1 if x else 0), x
    if isinstance(x, Number):
        n = canonical(x)
        if n is None:
            raise FilterError(f"{name}: number out of range")
        return 2, n
    if isinstance(x, str):
        if len(x) > STRING:
            raise FilterError(f"{name}: string too long")
        return 3, x
    raise FilterError(f"{name}: not a scalar")


def _order(x: tuple[int, object]) -> tuple:
    from decimal import Decimal

    return (x[0], Decimal(x[1]) if x[0] == 2 else 0, x[1].encode() if x[0] == 3 else b"")


@dataclass(frozen=True)
class TypedFilter:
    """Names, all of which must match, with their alternatives."""

    terms: tuple[tuple[str, tuple[tuple[int, object], ...]], ...] = ()

    @staticmethod
    def parse(text: str) -> TypedFilter:
        try:
            raw = load(text)
        except ValueError as e:
            raise FilterError("not valid JSON") from e
        if not isinstance(raw, _Pairs) or len(raw) > NAMES:
            raise FilterError("a filter is an object of at most 8 names")
        if len({k for k, _ in raw}) != len(raw):
            raise FilterError("a name is repeated")
        terms = []
        for name, value in sorted(raw, key=lambda p: p[0].encode()):
            if isinstance(value, _Pairs):
                if [k for k, _ in value] != ["in"] or isinstance(value[0][1], _Pairs) or not isinstance(value[0][1], list) or not 0 < len(value[0][1]) <= ALTERNATIVES:
                    raise FilterError(f"{name}: only in, with 1 to 64 values")
                values = [_scalar(name, x) for x in value[0][1]]
            else:
                values = [_scalar(name, value)]
            terms.append((name, tuple(sorted(set(values), key=_order))))
        out = TypedFilter(tuple(terms))
        if len(out.json().encode()) > CANONICAL:
            raise FilterError("filter too large")
        return out

    def json(self) -> str:
        show = lambda x: x[1] if x[0] == 2 else json.dumps(x[1], ensure_ascii=False)
        body = (f"{json.dumps(n, ensure_ascii=False)}:" + (show(v[0]) if len(v) == 1 else '{"in":[' + ",".join(map(show, v)) + "]}") for n, v in self.terms)
        return "{" + ",".join(body) + "}"

    def verdict(self, payload: Column, fields: dict[str, str]) -> Column:
        """1 match, 0 none, -1 malformed payload; fields maps declared names to dot paths."""
        for name, _ in self.terms:
            if name not in fields:
                raise FilterError(f"{name} is not filterable")
        tests = [(fields[n].split("."), set(v)) for n, v in self.terms]

        def found(x, path: list[str], wanted: set) -> bool:
            if isinstance(x, list) and not isinstance(x, _Pairs):
                return any(found(y, path, wanted) for y in x)
            if path:
                return isinstance(x, _Pairs) and any(found(y, path[1:], wanted) for k, y in x if k == path[0])
            if x is None or isinstance(x, _Pairs):
                return False
            if isinstance(x, Number):
                return (2, canonical(x)) in wanted
            return ((int(x), x) if isinstance(x, bool) else (3, x)) in wanted

        def one(text: str | None) -> int:
            try:
                x = load(text or "")
            except (ValueError, RecursionError):
                return -1
            return int(all(found(x, p, w) for p, w in tests))

        @F.pandas_udf("int")
        def run(s: pd.Series) -> pd.Series:
            return s.map(one).astype("int32")

        return run(payload)


def evaluated(df, flt: TypedFilter, fields: dict[str, str]):
    """The rows with flag 1 where the payload matches and 0 where not; a malformed payload among them fails the query."""
    checked = df.withColumn("flag", flt.verdict(F.col("payload"), fields))
    return checked.withColumn("flag", F.when(F.col("flag") < 0, F.raise_error(F.lit("malformed payload")).cast("int")).otherwise(F.col("flag")))


def string_filter(wanted: dict[str, str]) -> TypedFilter:
    """Names that must each equal a string."""
    return TypedFilter.parse(json.dumps(wanted)) if wanted else TypedFilter()


def flag_filter(flags: list[str]) -> TypedFilter:
    """string_filter of name=value flags; the first "=" divides, and a name comes once."""
    wanted: dict[str, str] = {}
    for flag in flags:
        name, equals, value = flag.partition("=")
        if not equals or not name or name in wanted:
            raise FilterError(f"{flag!r} is not name=value of a new name")
        wanted[name] = value
    return string_filter(wanted)
