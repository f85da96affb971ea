"""Command lines and replies: parsing and building them as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is trimmed, and the texts of replies.
BLANKS = " \t\r\n"
NOT_LEADER = "NOT_LEADER - Write to leader at port 9000"
STORED, DELETED, DELETE_FAILED, NOT_FOUND = "STORED", "DELETED", "DELETE_FAILED", "NOT_FOUND"
PONG, BYE, UNKNOWN_COMMAND, INVALID = "PONG", "BYE", "UNKNOWN_COMMAND", "INVALID"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _head(c: Column) -> Column:
    """Up to the first space."""
    return F.split_part(c, F.lit(" "), F.lit(1))


# How a line is taken apart: what follows the verb, and of it the first word and the rest.
REST = r"(?s)^[^ ]* [ \t\r\n]*(.+)$"
PAIR = r"(?s)^[^ ]* [ \t\r\n]*([^ ]+) [ \t\r\n]*(.+)$"


def _named(first: Column) -> Column:
    return F.when(first.isin("PUT", "SET"), "PUT").when(first.isin("DELETE", "DEL"), "DELETE").when(first.isin("QUIT", "EXIT"), "QUIT").when(first.isin("GET", "PING", "STATUS"), first).otherwise("UNKNOWN")


def with_command(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with ``verb, key, value`` of the command in column ``line``; columns of these names are replaced.

    The verb is read in any case. PUT needs a key without spaces and a value
    that isn't empty; the key of GET and DELETE is all the rest of the line.
    What can't be parsed is verb INVALID, an unknown verb UNKNOWN; a NULL or
    blank line is INVALID. Parts a verb doesn't have are NULL.

    Every step is a column of its own: as one expression the steps would be
    repeated inside each other and be too long to compile.
    """
    out = lines.withColumn("_text", _trim(F.coalesce(F.col(line), F.lit(""))))
    out = out.withColumn("_named", F.upper(F.substring_index("_text", " ", 1)))
    out = out.withColumn("_named", _named(F.col("_named")))
    # Neither matches an empty text, so '' says that a part is missing.
    out = out.withColumns({"_key": F.when(F.col("_named") == "PUT", F.regexp_extract("_text", PAIR, 1)).otherwise(F.regexp_extract("_text", REST, 1)), "_value": F.when(F.col("_named") == "PUT", F.regexp_extract("_text", PAIR, 2))})
    keyed = F.col("_named").isin("PUT", "GET", "DELETE")
    out = out.withColumn("_named", F.when((F.col("_text") == "") | (keyed & (F.col("_key") == "")), INVALID).otherwise(F.col("_named")))
    parts = {"verb": F.col("_named"), "key": F.when(F.col("_named").isin("PUT", "GET", "DELETE"), F.col("_key")), "value": F.when(F.col("_named") == "PUT", F.col("_value"))}
    return out.withColumns(parts).drop("_text", "_named", "_key", "_value")


def parse_command(line: Column) -> Column:
    """A command line as ``struct<verb, key, value>``; as ``with_command``, in one expression, for a few lines."""
    text = _trim(F.coalesce(line, F.lit("")))
    named = _named(F.upper(F.substring_index(text, " ", 1)))
    rest, broken = F.regexp_extract(text, REST, 1), text == ""
    broken = broken | ((named == "PUT") & ~text.rlike(PAIR)) | (named.isin("GET", "DELETE") & (rest == ""))
    verb = F.when(broken, INVALID).otherwise(named)
    return F.struct(
        verb.alias("verb"),
        F.when(verb == "PUT", F.regexp_extract(text, PAIR, 1)).when(verb.isin("GET", "DELETE"), rest).alias("key"),
        F.when(verb == "PUT", F.regexp_extract(text, PAIR, 2)).alias("value"),
    )


def parse_call(line: Column) -> Column:
    """A call such as ``put("k","v")`` as ``struct<verb, key, value>``.

    Case matters; texts stand between double quotes and know no escapes. LS,
    FLUSH and CLEAR must be the whole line. Everything else, NULL too, is ERROR.
    """
    text = F.coalesce(line, F.lit(""))
    key = F.regexp_extract(text, r'^[^"]*"([^"]*)"', 1)
    value = F.regexp_extract(text, r'^[^"]*"[^"]*"[^"]*"([^"]*)"', 1)
    one, two = text.rlike(r'^[^"]*"[^"]*"'), text.rlike(r'^[^"]*"[^"]*"[^"]*"[^"]*"')
    verb = (
        F.when(text.startswith("put(") & two, "PUT")
        .when(text.startswith("get(") & one, "GET")
        .when(text.startswith("delete(") & one, "DELETE")
        .when(text.isin("ls", "flush", "clear"), F.upper(text))
        .otherwise("ERROR")
    )
    return F.struct(verb.alias("verb"), F.when(verb.isin("PUT", "GET", "DELETE"), key).alias("key"), F.when(verb == "PUT", value).alias("value"))


def reply_line(success: Column, message: Column, value: Column) -> Column:
    """A reply as it goes over the wire: ``+VALUE v``, ``+OK m`` or ``-ERR m`` with line end."""
    return F.concat(F.when(value.isNotNull(), F.concat(F.lit("+VALUE "), value)).when(success, F.concat(F.lit("+OK "), message)).otherwise(F.concat(F.lit("-ERR "), message)), F.lit("\r\n"))


def parse_reply(line: Column) -> Column:
    """A reply line as ``struct<success, message, value>``; NULL if it is none."""
    text = _trim(line)
    sign, body = F.substring(text, 1, 1), F.substr(text, F.lit(2))
    two = F.instr(body, " ") > 0
    head, rest = _head(body), F.substr(body, F.instr(body, " ") + 1)
    valued = (sign == "+") & (head == "VALUE") & two
    message = F.when(valued, "OK").when(two, rest).otherwise(body)
    return F.when(sign.isin("+", "-"), F.struct((sign == "+").alias("success"), message.alias("message"), F.when(valued, rest).alias("value")))


def shown_value(value: Column) -> Column:
    """A value for people: JSON objects and arrays in one canonical spelling, else as it is."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(value)
