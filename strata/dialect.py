"""SQL text of the embedded dialect, rewritten to Spark SQL.

A small tokenizer keeps literals, quoted names and comments apart, so a rewrite never touches them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import glob_regex, register
from .operators import graph, vectors
from .scratch import scratch_path

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_@][A-Za-z0-9_.]*|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||\s+|.", re.S)
#: Most rounds of a recursive query.
RECURSION = 10_000
#: Names that only differ in spelling.
RENAMED = {"LEN": "length", "GETDATE": "current_timestamp", "AVERAGE": "avg", "VARIANCE": "var_samp", "STDDEV": "stddev_samp", "COVARIANCE": "covar_samp", "IIF": "if", "UNICODE": "unicode_of", "JULIANDAY": "julianday_of", "UNIXEPOCH": "unixepoch_of", "QUOTE": "quote_text", "ULID_NEW": "ulid_of", "ULID": "ulid_of", "SYNC_TIMESTAMP": "sync_timestamp_of"}
_STORED = "CASE WHEN {0} IS NULL THEN 'null' WHEN typeof({0}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({0}) IN ('float', 'double') OR typeof({0}) LIKE 'decimal%' THEN 'real' WHEN typeof({0}) = 'binary' THEN 'blob' ELSE 'text' END"
_VARIES = "(min({x}) < max({x}) OR isnan(min({x})))"  # a constant's merged variance can be a rounding error above 0
_CORR = "CASE WHEN count({0} + {1}) > 1 AND " + _VARIES.format(x="CASE WHEN {1} IS NOT NULL THEN {0} END") + " AND " + _VARIES.format(x="CASE WHEN {0} IS NOT NULL THEN {1} END") + " THEN try_divide(covar_pop({0}, {1}), stddev_pop(CASE WHEN {1} IS NOT NULL THEN {0} END) * stddev_pop(CASE WHEN {0} IS NOT NULL THEN {1} END)) END"
#: Parts of .NET date formats and what Spark calls them, longest first.
_NET = (("dddd", "EEEE"), ("ddd", "EEE"), ("ffffff", "SSSSSS"), ("fff", "SSS"), ("tt", "a"))
_COLLATE = {"NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM", "BINARY": "UTF8_BINARY"}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _next(parts: list[str], i: int) -> int:
    """Place of the next token that is not blank."""
    i += 1
    while i < len(parts) and (parts[i].isspace() or parts[i].startswith(("--", "/*"))):
        i += 1
    return i


def _closing(parts: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(parts)):
        depth += (parts[j] == "(") - (parts[j] == ")")
        if depth == 0:
            return j
    raise ValueError("a bracket is not closed")


def _arguments(parts: list[str], i: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket is at i, and the place of its end."""
    end, out, depth, own = _closing(parts, i), [], 0, []
    for p in parts[i + 1 : end]:
        depth += (p == "(") - (p == ")")
        if p == "," and depth == 0:
            out.append("".join(own).strip())
            own = []
        else:
            own.append(p)
    return [*out, "".join(own).strip()] if own or out else [], end


def _text(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _call(name: str, args: list[str]) -> str | None:
    """The Spark form of a call that is more than a renaming."""
    args = [rewrite(a) for a in args]
    if name == "TOTAL":
        return f"coalesce(sum(CAST({args[0]} AS DOUBLE)), 0.0D)"
    if name in ("GROUP_CONCAT", "STRING_AGG"):
        sep = args[1] if len(args) > 1 else "','"
        return f"listagg(nullif(CAST({args[0]} AS STRING), ''), {sep}) WITHIN GROUP (ORDER BY {args[0]})"
    if m := re.fullmatch(r"PERCENTILE_(\d+)", name):
        return f"percentile({args[0]}, {int(m[1]) / 100})"
    if name in ("MAX", "MIN") and len(args) > 1:
        return f"{'greatest' if name == 'MAX' else 'least'}({', '.join(args)})"
    if name == "DATEADD" and len(args) == 3 and args[2].startswith("'"):
        return f"timestampadd({_text(args[2]).upper().rstrip('S')}, {args[1]}, {args[0]})"
    if name == "STRFTIME" and args[0].startswith("'"):
        return _strftime(_text(args[0]), args[1], [_text(a) for a in args[2:]])
    if name == "STRFTIME" and len(args) == 2 and args[1].startswith("'"):
        return f"date_format({args[0]}, {_literal(net_format(_text(args[1])))})"
    if name == "DATETIME":
        return _strftime("%Y-%m-%d %H:%M:%S", args[0] if args else "current_timestamp()", [_text(a) for a in args[1:]])
    if name == "TYPEOF":
        return _STORED.format(args[0])
    if name == "CHAR":
        return f"concat({', '.join(f"decode(unhex(lpad(hex(CAST({a} AS BIGINT)), 8, '0')), 'UTF-32')" for a in args)})"
    if name in ("CORRELATION", "CORR"):
        return _CORR.format(*args)
    if name == "RANDOM" and not args:
        return "xxhash64(uuid())"
    if name == "MODE":
        return f"mode({args[0]}, true)"
    if name == "UNHEX":
        return f"decode(unhex({args[0]}), 'UTF-8')"
    if name in RENAMED:
        return f"{RENAMED[name]}({', '.join(args)})" if name != "GETDATE" else "current_timestamp()"
    return None


def _strftime(fmt: str, ts: str, modifiers: list[str]) -> str:
    for m in modifiers:
        if start := re.fullmatch(r"start of (day|month|year)", m.strip(), re.I):
            ts = f"CAST(date_trunc('{start[1]}', {ts}) AS TIMESTAMP_NTZ)"
        elif shift := re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|month|year)s?", m.strip(), re.I):
            ts = f"timestampadd({shift[2].upper()}, {int(shift[1])}, {ts})"
        else:
            raise ValueError(f"unknown modifier {m!r}")
    names = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}
    out = []
    for spec in re.findall(r"%.|[^%]+", fmt, re.S):
        if spec[0] != "%":
            out.append(_literal(spec))
        elif spec == "%%":
            out.append("'%'")
        elif spec == "%w":
            out.append(f"CAST(dayofweek({ts}) - 1 AS STRING)")
        else:
            out.append(f"date_format({ts}, '{names[spec[1]]}')")
    return f"concat({', '.join(out)})"


def net_format(fmt: str) -> str:
    """A .NET date format as Spark's pattern."""
    for theirs, own in _NET:
        fmt = fmt.replace(theirs, own)
    return fmt


def _unwrapped(parts: list[str], i: int) -> tuple[str, int] | None:
    """UNWRAP column AS name [DEFAULT literal] -> coalesce(column, literal) AS name."""
    m = re.match(r"UNWRAP\s+([\w.]+)\s+AS\s+(\w+)(?:\s+DEFAULT\s+('(?:[^']|'')*'|-?[\w.]+))?", "".join(parts[i:]), re.I)
    if not m:
        return None
    size, j = m.end(), i
    while size > 0:
        size -= len(parts[j])
        j += 1
    return (f"coalesce({m[1]}, {_literal(_text(m[3])) if m[3][0] == "'" else m[3]}) AS {m[2]}" if m[3] else f"{m[1]} AS {m[2]}"), j


def rewrite(sql: str) -> str:
    """Spark SQL of a statement or expression of the dialect."""
    parts, out, i = tokens(sql), [], 0
    while i < len(parts):
        word, upper = parts[i], parts[i].upper()
        j = _next(parts, i)
        after = parts[j].upper() if j < len(parts) else ""
        if upper == "IS":
            k = _next(parts, j) if after == "NOT" else j
            kind = parts[k].upper() if k < len(parts) else ""
            if kind in ("SOME", "NONE"):
                there = (kind == "SOME") != (after == "NOT")
                out.append("IS NOT NULL" if there else "IS NULL")
                i = k + 1
                continue
        if upper in ("GLOB", "REGEXP") and after.startswith("'"):
            pattern = _text(parts[j])
            out.append(f"RLIKE {_literal(glob_regex(pattern) if upper == 'GLOB' else pattern)}")
            i = j + 1
            continue
        if upper == "COLLATE" and after in _COLLATE:
            out.append(f"COLLATE {_COLLATE[after]}")
            i = j + 1
            continue
        if upper == "OPTIONALLY":
            i = j
            continue
        if upper == "UNWRAP" and (made := _unwrapped(parts, i)):
            text, i = made
            out.append(text)
            continue
        if upper == "MATCH" and after in ("SOME", "NONE"):
            k = _next(parts, j)
            out.append(f"{parts[k]} IS {'NOT ' if after == 'SOME' else ''}NULL")
            i = k + 1
            continue
        if after == "(" and re.fullmatch(r"[A-Z_][A-Z0-9_]*", upper):
            args, end = _arguments(parts, j)
            over = _windowed_filter(parts, end, word, args)
            if over:
                text, i = over
                out.append(text)
                continue
            made = _call(upper, args)
            if made is not None:
                out.append(made)
                i = end + 1
                continue
        out.append(word)
        i += 1
    text = "".join(out)
    if re.match(r"\s*WITH\s+RECURSIVE\b", text, re.I) and not re.search(r"MAX\s+RECURSION", text, re.I):
        text = re.sub(r"(\bWITH\s+RECURSIVE\s+\w+\s*(?:\([^)]*\)\s*)?)AS\b", rf"\1MAX RECURSION LEVEL {RECURSION} AS", text, count=1, flags=re.I)
    return _limits(text)


def _windowed_filter(parts: list[str], end: int, name: str, args: list[str]) -> tuple[str, int] | None:
    """agg(x) FILTER (WHERE c) OVER (...) -> agg(CASE WHEN c THEN x END) OVER (...)."""
    f = _next(parts, end)
    if f >= len(parts) or parts[f].upper() != "FILTER":
        return None
    b = _next(parts, f)
    close = _closing(parts, b)
    o = _next(parts, close)
    if o >= len(parts) or parts[o].upper() != "OVER":
        return None
    cond = re.sub(r"^\s*WHERE\s+", "", "".join(parts[b + 1 : close]), flags=re.I)
    arg = "1" if args == ["*"] else rewrite(args[0])
    return f"{name}(CASE WHEN {rewrite(cond)} THEN {arg} END) ", o


def _limits(sql: str) -> str:
    """TOP n, LIMIT m, n and FETCH FIRST n ROWS ONLY as LIMIT n OFFSET m."""
    sql = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", sql, flags=re.I)
    sql = re.sub(r"\bOFFSET\s+(\d+)\s+ROWS?\s+FETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY", r"LIMIT \2 OFFSET \1", sql, flags=re.I)
    sql = re.sub(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY", r"LIMIT \1", sql, flags=re.I)
    if top := re.match(r"\s*SELECT\s+TOP\s+(\d+)\s+", sql, re.I):
        sql = "SELECT " + sql[top.end() :] + f" LIMIT {top[1]}"
    return sql


class Database:
    """Statements of the dialect over the session's views; names bound as @p, :p or ?."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.procedures: dict[str, Callable[..., DataFrame]] = {}
        self.providers: dict[str, Callable[..., DataFrame]] = {"graph": graph.traverse}
        self.indexes: dict[tuple[str, str], vectors.IvfIndex] = {}
        register(spark)

    def provide(self, kind: str, provider: Callable[..., DataFrame]) -> None:
        """Replace a provider: 'graph' (edges, start, depth, strategy) -> node, or 'rag' (table, question, limit, top_k, min_score) -> node_id, score, context."""
        self.providers[kind] = provider

    def _view_of(self, df: DataFrame) -> str:
        name = f"found_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _traversals(self, sql: str) -> str:
        """GRAPH_TRAVERSE(table, start, column, depth [, strategy]) as a subquery: rows after IN, else a sorted array of nodes.

        The table's edges go from its first column to the named one.
        """
        parts, out, i = tokens(sql), [], 0
        while i < len(parts):
            j = _next(parts, i)
            if parts[i].upper() != "GRAPH_TRAVERSE" or j >= len(parts) or parts[j] != "(":
                out.append(parts[i])
                i += 1
                continue
            args, end = _arguments(parts, j)
            args = [a.strip("'\"`") for a in args]
            table = self.spark.table(args[0])
            start = self.spark.sql(f"SELECT {args[1]} AS x").first().x
            edges = graph.load_edges(table, table.columns[0], args[2])
            nodes = self._view_of(self.providers["graph"](edges, start, int(args[3]), args[4].lower() if len(args) > 4 else "bfs"))
            inside = re.search(r"\bIN\s*\(\s*$", "".join(out), re.I)
            out.append(f"SELECT node FROM {nodes}" if inside else f"(SELECT array_sort(collect_set(node)) FROM {nodes})")
            i = end + 1
        return "".join(out)

    def _rag(self, m) -> DataFrame:
        """SELECT columns FROM table GRAPH_RAG 'question' [LIMIT n] [WITH SCORE > x] [WITH CONTEXT] [TOP_K k]."""
        if "rag" not in self.providers:
            raise ValueError("provide('rag', ...) first: it turns questions into vectors")
        rest = m[4]
        number = lambda pattern: (x := re.search(pattern, rest, re.I)) and float(x[1])
        limit = int(number(r"\bLIMIT\s+(\d+)") or 10)
        found = self.providers["rag"](m[2], _text(m[3]), limit, int(number(r"\bTOP_K\s+(\d+)") or max(2 * limit, 10)), number(r"\bSCORE\s*>\s*([\d.]+)"))
        if not re.search(r"\bWITH\s+CONTEXT\b", rest, re.I):
            found = found.drop("context")
        return self.spark.sql(f"SELECT {m[1]} FROM {self._view_of(found)}")

    def vector_index(self, table: str, column: str, id_col: str, path: str | None = None) -> None:
        """CREATE VECTOR INDEX: searches of this column go through it; it is kept as Parquet below path."""
        index = vectors.IvfIndex(self.spark.table(table), id_col=id_col, col=column)
        path = path or scratch_path(self.spark, "vector-index")
        index.save(path)
        self.indexes[table.lower(), column.lower()] = vectors.IvfIndex.load(self.spark, path, id_col, column)

    def _indexed(self, m) -> DataFrame | None:
        """SELECT ... FROM t ORDER BY VEC_DISTANCE_x(column, vector) LIMIT k through an index of the column; adds `distance`."""
        index = self.indexes.get((m[2].lower(), m[4].lower()))
        if index is None:
            return None
        k, metric = int(m[6]), m[3].lower()
        q = self.spark.sql(f"SELECT CAST(-1 AS BIGINT) AS `{index.id_col}`, CAST({rewrite(m[5])} AS ARRAY<FLOAT>) AS `{index.col}`")
        near = index.search(q, k, metric=metric).select(F.col("id").alias(index.id_col), "distance", "rank")
        found = self.spark.table(m[2]).join(F.broadcast(near), index.id_col).orderBy("rank")  # k rows
        return self.spark.sql(f"SELECT {m[1]}, distance FROM {self._view_of(found)} ORDER BY rank")

    def query(self, sql: str, params: dict | list | None = None) -> DataFrame:
        if self.indexes and (near := re.match(r"\s*SELECT\s+(.*?)\s+FROM\s+(\w+)\s+ORDER\s+BY\s+VEC_DISTANCE_(L2|COSINE|DOT)\s*\(\s*(\w+)\s*,(.*)\)\s+LIMIT\s+(\d+)\s*$", sql, re.I | re.S)):
            found = self._indexed(near)
            if found is not None:
                return found
        if made := re.match(r"\s*CREATE\s+VECTOR\s+INDEX\s+\w+\s+ON\s+(\w+)\s*\(\s*(\w+)\s*\)\s*(?:KEY\s*\(\s*(\w+)\s*\))?", sql, re.I):
            self.vector_index(made[1], made[2], made[3] or self.spark.table(made[1]).columns[0])
            return self.spark.range(0)
        if rag := re.match(r"\s*SELECT\s+(.*?)\s+FROM\s+(\w+)\s+GRAPH_RAG\s+('(?:[^']|'')*')(.*)$", sql, re.I | re.S):
            return self._rag(rag)
        text = rewrite(self._traversals(sql))
        if isinstance(params, dict):
            df = self.spark.sql(re.sub(r"@([A-Za-z_]\w*)", r":\1", text), args=params)
        else:
            df = self.spark.sql(text, args=params) if params else self.spark.sql(text)
        if any(p.upper() == "OPTIONALLY" for p in tokens(sql)):
            df = df.select(*[F.struct(F.col(f"`{c}`").isNotNull().alias("is_some"), F.col(f"`{c}`").alias("value")).alias(c) for c in df.columns])
        return df

    def explain(self, sql: str) -> str:
        return self.query(sql)._jdf.queryExecution().toString()

    def procedure(self, name: str, sql: str) -> None:
        """A named statement with @parameters."""
        self.procedures[name.lower()] = lambda **p: self.query(sql, p)

    def execute(self, name: str, **params) -> DataFrame:
        return self.procedures[name.lower()](**params)
