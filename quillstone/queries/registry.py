"""How queries and their oracles are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans.dialect import DUCK, SPARK, SparkSql
from quillstone.sources.tables import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def frame(self, name: str, oracle: str | None = None):
        """Registers a function that builds a DataFrame, with the DuckDB SQL that must agree."""

        def register(f: Query) -> Query:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return register

    def sql(self, name: str, build: Callable[[SparkSql], str]) -> None:
        """Registers one relational text for both engines."""
        spark_text, duck_text = build(SPARK), build(DUCK)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", spark_text)]

        named = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(used) or 'none'})\b")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # tables are bound as arguments, not as shared views
            return spark.sql(named.sub(r"\1 {\2} AS \2", _braced(spark_text)), **{t: table(spark, sf_dir, t) for t in used})

        self.queries[name] = run
        self.oracles[name] = duck_text


def _braced(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")
