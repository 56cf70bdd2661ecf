"""Replies in the RESP form as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomkv.functions.text import command_error

END = "\r\n"


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit(END))


def error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit(END))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit(END))


def bulk(value: Column) -> Column:
    """A bulk string with its length in bytes; null is the null bulk."""
    return F.when(value.isNull(), F.lit("$-1" + END)).otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit(END), value, F.lit(END)))


def reply(op: Column, hit: Column, value: Column) -> Column:
    """What GET, SET and DEL of one key answer, given whether the key is live and its value."""
    return F.when(op == "GET", bulk(F.when(hit, value))).when(op == "SET", F.lit("+OK" + END)).when(op == "DEL", integer(hit.cast("int")))


def keyless(name: Column, n_args: Column, first: Column) -> Column:
    """PING (its argument is echoed), COMMAND (an empty array) and the errors of other lines; null where a key is needed."""
    bad = command_error(name, n_args)
    ping = F.when(n_args > 1, bulk(first)).otherwise(F.lit("+PONG" + END))
    n = F.upper(name)
    return F.when(bad.isNotNull(), error(bad)).when(n == "PING", ping).when(n == "COMMAND", F.lit("*0" + END))
