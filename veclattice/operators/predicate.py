"""Metadata predicates: a WHERE fragment with bound parameters, as a Column.

Accepted: comparisons, IN, BETWEEN and NULL tests, with AND, OR, NOT and
parentheses, over the columns of the table.  Values are `?`, bound in order,
or literals.  Nothing else is, so a fragment can't reach outside its table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidPredicate

_LEX = re.compile(r"\s*(?:(?P<number>-?\d+(?:\.\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|==|=|<|>|\(|\)|,|\?))")
_WORDS = {"and", "or", "not", "in", "between", "is", "null"}
_COMPARE = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class _Parser:
    def __init__(self, text: str, columns: list[str], params: list):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise InvalidPredicate(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = m.lastgroup
            value = m.group(kind)
            if kind == "name" and value.lower() in _WORDS:
                kind, value = "word", value.lower()
            self.tokens.append((kind, value))
            at = m.end()
        self.at, self.columns, self.params, self.used = 0, columns, list(params), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("word", "op") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise InvalidPredicate(f"expected {value!r}, got {self.peek()[1]!r}")

    def value(self) -> Column:
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            return F.lit(float(text) if "." in text else int(text))
        if kind == "string":
            return F.lit(text[1:-1].replace("''", "'"))
        if (kind, text) == ("op", "?"):
            if self.used == len(self.params):
                raise InvalidPredicate("too few parameters")
            self.used += 1
            p = self.params[self.used - 1]
            if p is not None and not isinstance(p, (str, int, float, bool)):
                raise InvalidPredicate("parameters are strings, numbers, booleans or null")
            return F.lit(p)
        raise InvalidPredicate(f"expected a value, got {text!r}")

    def any_of(self) -> Column:
        out = self.all_of()
        while self.take("or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.take("and"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.take("not"):
            return ~self.one()
        if self.take("("):
            out = self.any_of()
            self.need(")")
            return out
        kind, name = self.peek()
        if kind != "name":
            raise InvalidPredicate(f"expected a column, got {name!r}")
        if name not in self.columns:
            raise InvalidPredicate(f"no column {name!r}")
        self.at += 1
        column = F.col(f"`{name}`")
        if self.take("is"):
            negative = self.take("not")
            self.need("null")
            return column.isNotNull() if negative else column.isNull()
        negative = self.take("not")
        if self.take("in"):
            self.need("(")
            values = [self.value()]
            while self.take(","):
                values.append(self.value())
            self.need(")")
            out = column.isin(*values)
        elif self.take("between"):
            low = self.value()
            self.need("and")
            out = column.between(low, self.value())
        else:
            op = self.peek()[1]
            if negative or self.peek()[0] != "op" or op not in _COMPARE:
                raise InvalidPredicate(f"expected a comparison, got {op!r}")
            self.at += 1
            return getattr(column, _COMPARE[op])(self.value())
        return ~out if negative else out


def parse(fragment: str, columns: list[str], params: list | tuple = ()) -> Column:
    p = _Parser(fragment, columns, list(params))
    out = p.any_of()
    if p.peek()[0] != "end":
        raise InvalidPredicate(f"unexpected {p.peek()[1]!r}")
    if p.used != len(p.params):
        raise InvalidPredicate("too many parameters")
    return out


def where(table: DataFrame, fragment: str, params: list | tuple = ()) -> DataFrame:
    """Rows of the table that satisfy the fragment; Spark pushes it into the scan."""
    return table.where(parse(fragment, table.columns, params))
