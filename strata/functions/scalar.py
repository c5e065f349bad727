"""Scalar functions with SQLite-like semantics, as Column builders; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def iif(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


def typeof(x: Column | str, kind: str) -> Column:
    """SQLite's storage class of a column whose Spark type is `kind`."""
    names = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "binary": "blob"}
    name = "real" if kind.startswith("decimal") else names.get(kind, "text")
    return F.when(_col(x).isNull(), "null").otherwise(name)


def sign(x: Column | str) -> Column:
    return F.signum(_col(x)).cast("int")


def round_half_away(x: Column | str, digits: int = 0) -> Column:
    return F.round(_col(x), digits)


def instr(text: Column | str, part: str) -> Column:
    """1-based place of part, 0 if absent."""
    return F.instr(_col(text), part)


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a GLOB pattern (*, ?, [a-c], [^a-c])."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated, body = body[:1] in ("^", "!"), body.lstrip("^!") if body[:1] in ("^", "!") else body
            out.append("[" + "^" * negated + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$|()[]{}+*?-&" else c)
        i += 1
    return "^" + "".join(out) + "$"


def glob(text: Column | str, pattern: str) -> Column:
    """Case-sensitive GLOB."""
    return _col(text).rlike(glob_regex(pattern))


def not_regexp(text: Column | str, pattern: str) -> Column:
    """NOT REGEXP, true for NULL."""
    return F.coalesce(~_col(text).rlike(pattern), F.lit(True))


def unhex_text(x: Column | str) -> Column:
    """Hex digits as UTF-8 text; odd or invalid input is an error."""
    c = _col(x)
    ok = c.rlike("^([0-9A-Fa-f]{2})*$") | c.isNull()
    return F.when(ok, F.decode(F.unhex(c), "UTF-8")).otherwise(F.raise_error(F.lit("invalid hex text")))


def quote(x: Column | str, kind: str = "string") -> Column:
    """The value as an SQL literal."""
    c = _col(x)
    if kind == "binary":
        body = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif kind == "boolean":
        body = F.when(c, "1").otherwise("0")
    elif kind == "string":
        body = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        body = c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(body)


def char(*codes: Column | int) -> Column:
    """Code points to text: UTF-32 bytes decoded, so the whole range works."""
    one = lambda c: F.decode(F.unhex(F.lpad(F.hex((c if isinstance(c, Column) else F.lit(c)).cast("long")), 8, "0")), "UTF-32")
    return F.concat(*[one(c) for c in codes])


def unicode(x: Column | str) -> Column:
    """First code point; NULL for the empty text."""
    return F.when(_col(x) != "", F.ascii(_col(x)))


def sync_timestamp(ts: Column | None = None) -> Column:
    """Ticks of 100 ns since year 1, UTC."""
    return F.unix_micros(ts if ts is not None else F.current_timestamp()) * 10 + F.lit(621355968000000000)


def random_int64() -> Column:
    return F.xxhash64(F.uuid())


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(value: Column, digits: int) -> Column:
    place = lambda i: F.substring(F.lit(_CROCKFORD), F.shiftrightunsigned(value, 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.concat(*[place(i) for i in range(digits - 1, -1, -1)])


def ulid(ts: Column | None = None) -> Column:
    """A time-ordered id: 10 signs of milliseconds, 16 random signs."""
    millis = F.unix_millis(ts if ts is not None else F.current_timestamp())
    noise = [F.xxhash64(F.uuid()).bitwiseAND((1 << 40) - 1) for _ in range(2)]
    return F.concat(_base32(millis, 10), *[_base32(n, 8) for n in noise])


def ulid_millis(x: Column | str) -> Column:
    """The milliseconds in a ULID."""
    total = F.lit(0).cast("long")
    for i in range(10):
        total = total * 32 + F.instr(F.lit(_CROCKFORD), F.substring(_col(x), i + 1, 1)) - 1
    return total


def group_concat(x: Column | str, sep: str = ",", order: list[Column] | None = None) -> Column:
    """Texts that are neither NULL nor empty, joined; NULL if there are none. Ordered by value (or by `order` first)."""
    kept = F.when(_col(x).cast("string") != "", F.struct(*(order or []), _col(x).cast("string").alias("v")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["v"]), sep)
    return F.when(F.count(kept) > 0, joined)


def register(spark: SparkSession) -> None:
    """Register what the dialect needs by name: IIF, INSTR stays built in, VEC_*, JULIANDAY, UNIXEPOCH, UNICODE, QUOTE."""
    from .dates import JULIANDAY_SQL, UNIXEPOCH_SQL
    from .vector import SQL as VECTOR_SQL

    made = {
        "quote_text(x STRING)": ("STRING", "CASE WHEN x IS NULL THEN 'NULL' ELSE concat('''', replace(x, '''', ''''''), '''') END"),
        "unicode_of(x STRING)": ("BIGINT", "CASE WHEN x <> '' THEN ascii(x) END"),
        "julianday_of(ts TIMESTAMP_NTZ)": ("DOUBLE", JULIANDAY_SQL),
        "unixepoch_of(ts TIMESTAMP_NTZ)": ("BIGINT", UNIXEPOCH_SQL),
        "sync_timestamp_of()": ("BIGINT", "unix_micros(current_timestamp()) * 10 + 621355968000000000"),
        "ulid_of()": ("STRING", "concat(" + ", ".join([f"substr('{_CROCKFORD}', CAST((shiftrightunsigned(unix_millis(current_timestamp()), {5 * i}) & 31) AS INT) + 1, 1)" for i in range(9, -1, -1)] + [f"substr('{_CROCKFORD}', CAST((xxhash64(uuid()) & 31) AS INT) + 1, 1)"] * 16) + ")"),
        **VECTOR_SQL,
    }
    for head, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
