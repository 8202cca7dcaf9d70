"""One query text for two engines: Spark SQL, and DuckDB as its oracle.

Queries that are plain relational SQL are written once against these small
differences; both engines then plan and run them on their own.
"""

from __future__ import annotations

from quillstone.functions.text import WORD


class SparkSql:
    engine = "spark"

    def words(self, t: str) -> str:
        return f"regexp_extract_all(lower({t}), '{_escaped(WORD)}', 0)"

    def raw(self, t: str) -> str:
        return rf"filter(split({t}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+'), x -> x <> '')"

    def grams(self, w: str, n: int) -> str:
        return f"CASE WHEN size({w}) >= {n} THEN transform(sequence(1, size({w}) - {n - 1}), i -> array_join(slice({w}, i, {n}), ' ')) ELSE array() END"

    def rows(self, source: str, array: str, pos: str, value: str) -> str:
        """The source's rows, once for each entry of an array column; pos counts from 0.

        The outer form keeps the optimizer from testing the array, and so
        computing all that it is made of, a second time.
        """
        return f"(SELECT * FROM (SELECT src.*, u.{pos}, u.{value} FROM {source} AS src LATERAL VIEW OUTER posexplode({array}) u AS {pos}, {value}) WHERE {pos} IS NOT NULL)"

    def h32(self, s: str) -> str:
        return f"CAST(conv(substr(md5(cast({s} as binary)), 1, 8), 16, 10) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"size({a})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def each(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {x} -> {body})"

    def kept(self, a: str, x: str, body: str) -> str:
        return f"filter({a}, {x} -> {body})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def gather(self, x: str, order: str) -> str:
        """An array of x in the group, ordered by a key that has no ties."""
        return f"transform(array_sort(collect_list(named_struct('k', {order}, 'v', {x}))), s -> s.v)"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def part(self, a: str, lo: str, n: str) -> str:
        """n entries from the lo-th (counting from 1)."""
        return f"slice({a}, {lo}, {n})"

    def at(self, a: str, i: str) -> str:
        return f"element_at({a}, {i})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def bytes(self, t: str) -> str:
        return f"octet_length({t})"

    def vec(self, a: str) -> str:
        return f"CAST({a} AS array<double>)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)"

    def match_all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, '{_escaped(pattern)}', 0)"

    def extract(self, t: str, pattern: str, group: int) -> str:
        return f"regexp_extract({t}, '{_escaped(pattern)}', {group})"

    def replace_all(self, t: str, pattern: str, by: str) -> str:
        return f"regexp_replace({t}, '{_escaped(pattern)}', '{by}')"

    def matches(self, t: str, pattern: str) -> str:
        return f"({t} RLIKE '{_escaped(pattern)}')"

    def half_even(self, x: str) -> str:
        return f"rint({x})"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def values(self, name: str, columns: str, rows: list[tuple]) -> str:
        return f"{name} AS (SELECT * FROM VALUES {', '.join(map(_row, rows))} AS v({columns}))"

    def sha256(self, t: str) -> str:
        return f"sha2({t}, 256)"

    def micros(self, t: str) -> str:
        return f"unix_micros(CAST({t} AS TIMESTAMP))"

    def split(self, t: str, pattern: str) -> str:
        return f"split({t}, '{_escaped(pattern)}', -1)"

    def pick(self, condition: str) -> str:
        """Rows of the group that meet a condition."""
        return f"count_if({condition})"

    def try_int(self, t: str) -> str:
        return f"try_cast(trim({t}) AS BIGINT)"

    def try_double(self, t: str) -> str:
        return f"try_cast({t} AS DOUBLE)"

    def last(self, a: str) -> str:
        return f"try_element_at({a}, -1)"

    def chars(self, t: str) -> str:
        return f"split({t}, '')"

    def same(self, a: str, b: str) -> str:
        return f"({a} <=> {b})"

    def repeat(self, x: str, n: str) -> str:
        return f"array_repeat({x}, {n})"

    def cat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def rnd(self, x: str) -> str:
        return f"round({x}, 6)"

    def json(self, t: str, key: str) -> str:
        return f"get_json_object({t}, '$.{key}')"


class DuckSql(SparkSql):
    engine = "duckdb"

    def words(self, t: str) -> str:
        return f"regexp_extract_all(lower({t}), '{_quoted(WORD)}')"

    def raw(self, t: str) -> str:
        return rf"list_filter(regexp_split_to_array({t}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda x: x <> '')"

    def grams(self, w: str, n: int) -> str:
        return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i : i + {n - 1}], ' ')) ELSE [] END"

    def rows(self, source: str, array: str, pos: str, value: str) -> str:
        return f"(SELECT src.*, generate_subscripts({array}, 1) - 1 AS {pos}, unnest({array}) AS {value} FROM {source} AS src)"

    def h32(self, s: str) -> str:
        return f"CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"len({a})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def each(self, a: str, x: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}: {body})"

    def kept(self, a: str, x: str, body: str) -> str:
        return f"list_filter({a}, lambda {x}: {body})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def gather(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def part(self, a: str, lo: str, n: str) -> str:
        return f"{a}[({lo}) : ({lo}) + ({n}) - 1]"

    def at(self, a: str, i: str) -> str:
        return f"{a}[{i}]"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def bytes(self, t: str) -> str:
        return f"strlen({t})"

    def vec(self, a: str) -> str:
        return f"CAST({a} AS DOUBLE[])"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product({a}, {b})"

    def match_all(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, '{_quoted(pattern)}')"

    def extract(self, t: str, pattern: str, group: int) -> str:
        return f"regexp_extract({t}, '{_quoted(pattern)}', {group})"

    def replace_all(self, t: str, pattern: str, by: str) -> str:
        return f"regexp_replace({t}, '{_quoted(pattern)}', '{by}', 'g')"

    def matches(self, t: str, pattern: str) -> str:
        return f"regexp_matches({t}, '{_quoted(pattern)}')"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def values(self, name: str, columns: str, rows: list[tuple]) -> str:
        return f"{name}({columns}) AS (VALUES {', '.join(map(_row, rows))})"

    def sha256(self, t: str) -> str:
        return f"sha256({t})"

    def micros(self, t: str) -> str:
        return f"epoch_us({t})"

    def split(self, t: str, pattern: str) -> str:
        return f"regexp_split_to_array({t}, '{_quoted(pattern)}')"

    def pick(self, condition: str) -> str:
        return f"count(*) FILTER ({condition})"

    def last(self, a: str) -> str:
        return f"{a}[-1]"

    def chars(self, t: str) -> str:
        return f"string_split({t}, '')"

    def same(self, a: str, b: str) -> str:
        return f"({a} IS NOT DISTINCT FROM {b})"

    def repeat(self, x: str, n: str) -> str:
        return f"list_transform(range({n}), lambda rep: {x})"

    def cat(self, *arrays: str) -> str:
        return f"list_concat({', '.join(arrays)})" if len(arrays) == 2 else f"list_concat({arrays[0]}, {self.cat(*arrays[1:])})"

    def json(self, t: str, key: str) -> str:
        return f"json_extract_string({t}, '$.{key}')"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _escaped(pattern: str) -> str:
    """A pattern inside a Spark SQL string literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _row(row: tuple) -> str:
    return "(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")"


SPARK, DUCK = SparkSql(), DuckSql()
