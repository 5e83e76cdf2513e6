"""Event payloads: JSON maps whose values are text or base64 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "base64:"


def decode_payload(json: Column) -> Column:
    """map<string,string> of a JSON object."""
    return F.from_json(json, "map<string,string>")


def encode_value(value: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.base64(value.cast("binary")))


def decode_value(value: Column) -> Column:
    """Prefixed values decoded, a failure to null; other values as they are."""
    body = F.substring(value, len(PREFIX) + 1, 1 << 30)
    return F.when(F.startswith(value, F.lit(PREFIX)), F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).otherwise(value)


def text_of(value: Column, kind: T.DataType) -> Column:
    """The text that values are compared and stored by: True and False, floats in the fewest digits that give them back.

    From 1e16 on and below 1e-4 these have an exponent of two digits or more. Of the least
    floats of all (subnormal ones) the text may have a digit more than it needs.
    """
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return value.cast("string")
    x = value.cast("double")
    tried = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    own = F.coalesce(*[F.when(t.try_cast("double") == x, t) for t in tried])
    odd = F.when(F.isnan(x), F.lit("nan")).when(x == F.lit(float("inf")), F.lit("inf")).when(x == F.lit(float("-inf")), F.lit("-inf"))
    # lambdas bind what is used more than once, or the generated code would hold it as often
    return F.coalesce(odd, F.get(F.transform(F.transform(F.array(own), _parts), _written), F.lit(0)))


def _parts(own: Column) -> Column:
    """Sign, digits and power of ten of a float's text with an exponent."""
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(own, "e", 1), "[-.]", ""), "(?<=.)0+$", "")
    sign = F.when(F.startswith(own, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.struct(sign.alias("sign"), digits.alias("digits"), F.substring_index(own, "e", -1).try_cast("int").alias("power"))


def _written(parts: Column) -> Column:
    sign, digits, power = parts["sign"], parts["digits"], parts["power"]
    rest, behind = F.substring(digits, 2, 400), F.call_function("substring", digits, power + 2, F.lit(400))
    plain = F.concat(sign, F.rpad(F.call_function("substring", digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(behind == "", F.lit("0")).otherwise(behind))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(sign, F.substring(digits, 1, 1), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    return F.when(power.between(0, 15), plain).when(power.between(-4, -1), small).otherwise(exponent)


def field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def json_safe(*columns: Column) -> Column:
    """Columns as one JSON object; bytes become base64, nested values their JSON, nulls are left out."""
    return F.to_json(F.struct(*columns))
