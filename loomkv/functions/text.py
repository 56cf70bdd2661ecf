"""Grammar pieces and sizes as native expressions: the SQL subset, SET options, byte sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SQL_TTL_MS = 86_400_000
BLANK = " \t\n\r"
UNITS = {"kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "kb": 10**3, "mb": 10**6, "gb": 10**9}


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token(x: Column) -> Column:
    """Trimmed and unquoted token; blank, or a lone quote, is null (a parse error); '' is the empty string."""

    def unquoted(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        quoted = first.isin("'", '"') & (F.substring(t, -1, 1) == first) & (F.length(t) > 1)
        return F.when(t.isin("", "'", '"'), F.lit(None).cast("string")).when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    return bind(_trim(x), unquoted)


def parse_sql(text: Column) -> Column:
    """struct(op, key, value, ttl_ms, error) of one statement of the SQL subset."""

    def after(s: Column, at: Column, n: int) -> Column:
        return F.substring(s, at + n, F.length(s))

    def keyed(s: Column) -> Column:
        """The token behind the first = that follows WHERE."""
        tail = F.when(F.instr(s["low"], "where") > 0, after(s["t"], F.instr(s["low"], "where"), 5))
        return bind(tail, lambda x: token(F.when(F.instr(x, "=") > 0, after(x, F.instr(x, "="), 1))))

    def listed(s: Column) -> Column:
        """Tokens of the list in brackets that follows VALUES."""
        tail = F.when(F.instr(s["low"], "values") > 0, after(s["t"], F.instr(s["low"], "values"), 6))
        return F.transform(F.split(F.regexp_extract(tail, r"(?s)^[^(]*\(([^)]*)\)", 1), ",", -1), token)

    def found(s: Column) -> Column:
        op = F.when(s["low"].startswith("select"), "GET").when(s["low"].startswith("insert"), "SET").when(s["low"].startswith("delete"), "DELETE")
        part = F.when(op == "SET", listed(s)).otherwise(F.array(keyed(s)))
        return F.struct(op.alias("op"), part.alias("part"))

    def judged(x: Column) -> Column:
        op, key, value = x["op"], F.get(x["part"], F.lit(0)), F.get(x["part"], F.lit(1))
        digits = F.regexp_extract(F.coalesce(F.get(x["part"], F.lit(2)), F.lit("")), r"^[0-9]+", 0)
        ttl = F.when(digits == "", F.lit(0).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), F.lit(2**63 - 1)))
        bad = op.isNull() | key.isNull() | ((op == "SET") & value.isNull())
        return F.struct(op.alias("op"), key.alias("key"), value.alias("value"), ttl.alias("ttl"), bad.alias("bad"))

    def answer(y: Column) -> Column:
        late = (y["op"] == "SET") & (y["ttl"] > MAX_SQL_TTL_MS)
        ok = ~y["bad"] & ~late
        error = F.when(y["bad"], "parse error").when(late, "ttl overflow")
        return F.struct(
            F.when(~y["bad"], y["op"]).alias("op"), F.when(ok, y["key"]).alias("key"), F.when(ok & (y["op"] == "SET"), y["value"]).alias("value"),
            F.when(ok & (y["op"] == "SET"), y["ttl"]).alias("ttl_ms"), error.alias("error"),
        )

    both = bind(_trim(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    return bind(bind(bind(both, found), judged), answer)


def set_ttl(n_args: Column, option: Column, amount: Column) -> Column:
    """struct(ttl_ms, error) of the options of SET: none, EX seconds or PX milliseconds."""
    n, o = amount.try_cast("long"), F.upper(option)
    fine = (n_args == 5) & o.isin("EX", "PX") & n.isNotNull() & (n >= 0) & amount.rlike(r"^[+-]?[0-9]+$")
    ms = F.when(n_args == 3, F.lit(0).cast("long")).when(fine, F.when(o == "EX", F.try_multiply(n, F.lit(1000).cast("long"))).otherwise(n))
    return F.struct(ms.alias("ttl_ms"), F.when(~((n_args == 3) | fine), "ERR syntax error").alias("error"))


def command_error(name: Column, n_args: Column) -> Column:
    """The error text of a RESP command line, null when name and arity are right."""
    n = F.upper(name)
    known = {"GET": n_args == 2, "SET": n_args.isin(3, 5), "DEL": n_args >= 2, "PING": n_args >= 1, "COMMAND": n_args >= 1}
    out = F.lit(None).cast("string")
    for k, arity in known.items():
        out = F.when(n == k, F.when(~arity, F.concat(F.lit("ERR wrong number of arguments for '"), F.lower(name), F.lit("' command")))).otherwise(out)
    return F.when(~n.isin(*known), F.concat(F.lit("ERR unknown command '"), name, F.lit("'"))).otherwise(out)


def binary_response(op: Column, hit: Column, value: Column) -> Column:
    return F.when(op == "GET", F.when(hit, value).otherwise("ERR NOT_FOUND")).when(op.isin("SET", "DEL"), "OK").otherwise("ERR unknown operation")


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 16MiB or 256KB (64-bit); null where it is none."""
    t = F.lower(_trim(text))
    n, unit = F.regexp_extract(t, r"^([0-9]+)([kmg]i?b)?$", 1), F.regexp_extract(t, r"^([0-9]+)([kmg]i?b)?$", 2)
    factor = F.lit(1).cast("long")
    for k, v in UNITS.items():
        factor = F.when(unit == k, F.lit(v).cast("long")).otherwise(factor)
    return F.when(n != "", F.try_multiply(n.try_cast("long"), factor))


def format_byte_size(n: Column) -> Column:
    """The largest binary unit that divides the size; zero stands for the default of 16 MiB."""
    out = n.cast("string")
    for name, v in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = F.when((n % v == 0) & (n >= v), F.concat((n / v).cast("long").cast("string"), F.lit(f" {name}"))).otherwise(out)
    return F.when(n == 0, "16 MiB").otherwise(out)
