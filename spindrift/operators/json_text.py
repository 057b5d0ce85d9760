"""JSON as text: strings quoted, ASCII escapes, canonical form, call keys.

All of it is made of Spark's functions. Escapes are told apart by cutting a text into escapes and
the runs between them, from left to right, so a backslash that is itself escaped never begins one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pieces(text: Column, pattern: str, change) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), change), "")


def _once(value: Column, change) -> Column:
    """``change`` of a value that is worked out once, however often ``change`` names it."""
    return F.element_at(F.transform(F.array(value), change), 1)


def small_escapes(json: Column) -> Column:
    r"""Control characters as ``\u001b`` (Spark writes ``\u001B``)."""
    slow = lambda j: _pieces(j, r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[^\\]+", lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p))
    return _once(json, lambda j: F.when(F.contains(j, F.lit("\\u")), slow(j)).otherwise(j))


def ascii_only(json: Column) -> Column:
    r"""Characters beyond the printable ones of ASCII as ``\u00e9``, beyond 16 bits as two such units."""
    units = lambda run: F.lower(F.regexp_replace(F.hex(F.encode(run, "UTF-16BE")), "(.{4})", r"\\u$1"))
    slow = lambda j: _pieces(j, r"[\x00-\x7E]+|[^\x00-\x7E]+", lambda run: F.when(F.ascii(run) < 127, run).otherwise(units(run)))
    return _once(json, lambda j: F.when(F.regexp_like(j, F.lit(r"[^\x00-\x7E]")), slow(j)).otherwise(j))


def quoted(text: Column) -> Column:
    """A string as JSON, ``null`` for null."""
    return small_escapes(F.btrim(F.to_json(F.array(text)), F.lit("[]")))  # the string itself is between quotes


def canonical(json: Column, ascii: bool = True) -> Column:
    """One text for all spellings of a JSON value, of any depth: no white space, keys in order, equal numbers alike.

    Numbers are written as Spark's variants are: 1, 1.0 and 1.00 are ``1``; numbers with an exponent are doubles.
    Text that is no JSON fails the job, and so does an object that has a key twice.
    """
    text = small_escapes(F.to_json(F.parse_json(json)))
    return ascii_only(text) if ascii else text


def call_key(provider: Column, model: Column, seed: Column, messages: Column) -> Column:
    """16 hex digits for a call; ``messages`` is an array of structs with role and content, in order."""
    each = F.transform(messages, lambda m: F.concat(F.lit('{"content":'), quoted(m["content"]), F.lit(',"role":'), quoted(m["role"]), F.lit("}")))
    parts = [F.lit('{"messages":['), F.array_join(each, ","), F.lit('],"model":'), quoted(model), F.lit(',"provider_name":'), quoted(provider), F.lit(',"seed":'), seed.cast("string"), F.lit("}")]
    return F.substring(F.sha2(ascii_only(F.concat(*parts)), 256), 1, 16)


def json_list(items: Column, each, depth: int) -> Column:
    """An array as JSON, ``each`` item on its own line, indented by two blanks a level; an empty one as just brackets."""
    pad, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[" + pad), F.array_join(F.transform(items, each), "," + pad), F.lit(end + "]")))


def json_object(fields: dict[str, Column], depth: int) -> Column:
    """An object with at least one field, in the given order and the same layout."""
    pad, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.concat(F.lit("{" + pad), F.array_join(F.array(*[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), "," + pad), F.lit(end + "}"))
