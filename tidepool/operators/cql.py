"""A small log query language, compiled to Column expressions.

SELECT lines | count() | min(f) | max(f) | avg(f) [WHERE expr] [LIMIT n]; expr joins comparisons
with AND and OR (AND binds closer). Fields: text, template, slot[N]. The limit comes before the
aggregate. NOT negates LIKE only; before any other comparison it is read and has no effect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.text import cql_like

_LEXER = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<slot>slot\[\d+\])|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[(),]))""", re.IGNORECASE)
NUMERIC = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


class CqlError(ValueError):
    """The query does not parse."""


def tokenize(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = _LEXER.match(query, at)
        if not m:
            raise CqlError(f"unexpected text at {at}: {query[at : at + 20]!r}")
        kind = m.lastgroup or ""
        value = m.group(kind)
        out.append((kind, value[1:-1] if kind == "string" else value))
        at = m.end()
    return out


@dataclass
class Plan:
    target: tuple[str, str | None]
    where: Any
    limit: int | None


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def keyword(self, word: str) -> bool:
        if self.peek()[1].upper() == word and self.peek()[0] == "word":
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if self.take()[1] != value:
            raise CqlError(f"{value!r} is missing")

    def plan(self) -> Plan:
        if not self.keyword("SELECT"):
            raise CqlError("a query begins with SELECT")
        name, field = self.take()[1].lower(), None
        if name in ("count", "min", "max", "avg"):
            self.expect("(")
            if name != "count":
                field = self.take()[1].lower()
            self.expect(")")
        elif name != "lines":
            raise CqlError(f"unknown target {name!r}")
        where = self.either() if self.keyword("WHERE") else None
        limit = None
        if self.keyword("LIMIT"):
            kind, n = self.take()
            if kind != "number":
                raise CqlError("LIMIT wants a number")
            limit = int(float(n))
        if self.peek()[0] != "end":
            raise CqlError(f"unexpected {self.peek()[1]!r}")
        return Plan((name, field), where, limit)

    def either(self) -> Any:
        left = self.both()
        while self.keyword("OR"):
            left = ("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.one()
        while self.keyword("AND"):
            left = ("and", left, self.one())
        return left

    def one(self) -> Any:
        if self.peek()[1] == "(":
            self.take()
            inner = self.either()
            self.expect(")")
            return inner
        negated = self.keyword("NOT")
        field = self.take()[1].lower()
        negated = self.keyword("NOT") or negated
        if self.keyword("LIKE"):
            return ("like", field, self.take()[1], negated)
        kind, op = self.take()
        if kind != "op":
            raise CqlError(f"an operator is missing after {field!r}")
        return ("compare", field, op, *self.take())


def parse(query: str) -> Plan:
    return _Parser(tokenize(query)).plan()


def field(name: str) -> Column:
    """A slot beyond the last is empty; an unknown name is the text."""
    if m := re.fullmatch(r"slot\[(\d+)\]", name):
        return F.coalesce(F.try_element_at("slots", F.lit(int(m[1]) + 1)), F.lit(""))
    return F.col(name if name in ("template", "text") else "text")


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))


def condition(tree: Any) -> Column:
    if tree[0] in ("and", "or"):
        a, b = condition(tree[1]), condition(tree[2])
        return (a & b) if tree[0] == "and" else (a | b)
    if tree[0] == "like":
        hit = cql_like(field(tree[1]), tree[2])
        return ~hit if tree[3] else hit
    _, name, op, kind, value = tree
    text = field(name)
    n = number(text)
    ordered = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    as_text = {"=": text == value, "!=": text != value, ">": text > value}.get(op, text < value)  # >= and <= of texts compare as <
    if re.match(NUMERIC, value):
        plain = as_text if op in ("=", "!=") else F.lit(False)
        return F.when(n.isNotNull(), ordered[op](n, F.lit(float(value)))).otherwise(plain)
    return as_text


def execute(rows: DataFrame, query: str) -> DataFrame:
    """rows: line_no, text, template, slots. Lines come as (line_no, text), aggregates as one row (value)."""
    plan = parse(query)
    out = rows.where(condition(plan.where)) if plan.where else rows
    if plan.limit is not None:
        out = out.orderBy("line_no").limit(plan.limit)
    kind, name = plan.target
    if kind == "lines":
        return out.select("line_no", "text")
    if kind == "count":
        return out.agg(F.count("*").cast("double").alias("value"))
    return out.agg(getattr(F, kind)(number(field(name))).alias("value"))
