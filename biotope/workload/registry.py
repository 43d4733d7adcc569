"""Registry of bound queries and their oracle SQL.

A binding names the base relations its SQL reads; their texts are put in front as
common table expressions. Columns listed in ``rounded`` are rounded to the same
number of decimals on both sides, because the order of a floating-point sum is free.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.workload.relations import RELATION_SQL, Tables


@dataclass(frozen=True)
class Binding:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    needs: tuple[str, ...]
    rounded: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(
            *[
                (F.round(F.col(c), self.digits) + F.lit(0.0)).alias(c) if c in self.rounded else F.col(c)
                for c in df.columns
            ]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        ordered = relation_closure(self.needs)
        parts = ", ".join(f"{name} AS ({RELATION_SQL[name][1].strip()})" for name in ordered)
        opening = "WITH RECURSIVE" if body.startswith("WITH RECURSIVE ") else "WITH"
        if body.startswith(f"{opening} "):
            head = f"{opening} {parts}, {body[len(opening):]}" if parts else body
        else:
            head = f"WITH {parts} {body}" if parts else body
        if not self.rounded:
            return head
        replaced = ", ".join(f"round({c}, {self.digits}) + 0.0 AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({replaced}) FROM ({head}) AS result"


BINDINGS: dict[str, Binding] = {}


def relation_closure(names: Sequence[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in RELATION_SQL[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def bind(
    name: str,
    sql: str | None = None,
    needs: Sequence[str] | str = (),
    rounded: Sequence[str] | str = (),
    digits: int = 6,
):
    def split(value: Sequence[str] | str) -> tuple[str, ...]:
        return tuple(value.split()) if isinstance(value, str) else tuple(value)

    def register(build: Callable[[Tables], DataFrame]):
        if name in BINDINGS:
            raise ValueError(f"query bound twice: {name}")
        BINDINGS[name] = Binding(name, build, sql, split(needs), split(rounded), digits)
        return build

    return register
