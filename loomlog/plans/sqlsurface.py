"""SQL over streams and key/value tables: names are resolved, ``LAST`` is rewritten, Catalyst does the rest."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlog.functions.last import rewrite_last

_PART = r"""(?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|[^\W\d]\w*)"""
_TOKEN = re.compile(rf"""(?P<skip>'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)|(?P<name>{_PART}(?:\s*\.\s*{_PART})*)|(?P<other>.)""", re.DOTALL)


def _plain(part: str) -> str:
    return part[1:-1].replace(part[0] * 2, part[0]) if part[0] in "\"`" else part


class Surface:
    """A catalog of named tables under one ``catalog.schema``. Tables are made when a query names them, not before."""

    def __init__(self, spark: SparkSession, catalog: str = "log", schema: str = "public") -> None:
        self.spark, self.catalog, self.schema = spark, catalog, schema
        self.tables: dict[str, Callable[[], DataFrame]] = {}
        self._views: dict[str, str] = {}

    def register(self, name: str, table: Callable[[], DataFrame] | DataFrame) -> None:
        """A second table of the same name is an error."""
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = table if callable(table) and not isinstance(table, DataFrame) else (lambda: table)

    def register_pairs(self, name: str, pairs: list[str]) -> None:
        """A table ``key, value`` (binary) from texts ``key=value``, as a command line gives them; all that follows the first ``=`` is the value."""
        rows = []
        for pair in pairs:
            key, mark, value = pair.partition("=")
            if not mark:
                raise ValueError(f"not key=value: {pair!r}")
            rows.append((bytearray(key.encode()), bytearray(value.encode())))
        self.register(name, lambda: self.spark.createDataFrame(rows, "key binary, value binary"))

    def deregister(self, name: str) -> bool:
        if view := self._views.pop(name, None):
            self.spark.catalog.dropTempView(view)
        return self.tables.pop(name, None) is not None

    def exists(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return sorted(self.tables)

    def _view(self, name: str) -> str:
        if name not in self._views:
            view = f"surface_{uuid.uuid4().hex}"
            self.tables[name]().createOrReplaceTempView(view)
            self._views[name] = view
        return self._views[name]

    def _resolve(self, name: str) -> str | None:
        parts = re.findall(_PART, name)
        plain = [_plain(p) for p in parts]
        for known in ([self.catalog, self.schema], [self.schema], []):
            if plain[: len(known)] == known and len(plain) > len(known):
                rest = plain[len(known) :]
                for n in range(len(rest), 0, -1):
                    if (table := ".".join(rest[:n])) in self.tables and (n == len(rest) or not known):
                        tail = "".join(f".`{p}`" for p in rest[n:])
                        return f"`{self._view(table)}`{tail}"
        return None

    def rewrite(self, sql: str) -> str:
        """Names of tables become views; other names in double quotes become backticked."""
        out, after, depth_from = [], "", False
        for m in _TOKEN.finditer(sql):
            if m["name"] is None:
                out.append(m[0])
                if m[0] == ",":
                    after = "," if depth_from else ""
                elif not m[0].isspace():
                    after = "("
                continue
            word = m[0].upper()
            relation = after in ("FROM", "JOIN") or after == "," and depth_from
            known = self._resolve(m[0]) if relation or "." in m[0] or m[0][0] in "\"`" else None
            if relation and known:
                alias = _plain(re.findall(_PART, m[0])[-1])
                nxt = re.match(rf"\s+(?:as\s+)?({_PART})", sql[m.end() :], re.IGNORECASE)
                taken = nxt and nxt[1].upper() not in _STOP
                out.append(known if taken else f"{known} AS `{alias}`")
            elif m[0][0] == '"':
                out.append("".join("`" + _plain(p).replace("`", "``") + "`" if i == 0 else ".`" + _plain(p) + "`" for i, p in enumerate(re.findall(_PART, m[0]))))
            else:
                out.append(m[0])
            if word in ("FROM", "JOIN"):
                depth_from = word == "FROM" or depth_from
                after = word
            else:
                if word in _STOP - {"ON", "USING", "AS"}:
                    depth_from = False
                after = word
        return "".join(out)

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(rewrite_last(self.rewrite(sql)))

    def query_key_values(self, sql: str) -> DataFrame:
        """The first two columns, which must be binary, as ``key, value``."""
        df = self.query(sql)
        if len(df.columns) < 2 or [t for _, t in df.dtypes[:2]] != ["binary", "binary"]:
            raise ValueError("the query has to begin with two binary columns")
        return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).selectExpr("c0 AS key", "c1 AS value")


_STOP = {"WHERE", "GROUP", "ORDER", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "USING", "HAVING", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "OFFSET", "SEMI", "ANTI", "NATURAL", "LATERAL", "SELECT", "AS"}
