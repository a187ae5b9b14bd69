"""Value codecs: Spark columns <-> bytes. Integers are little-endian two's complement."""

from __future__ import annotations

import decimal
import json
import struct
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = {"i8": 1, "u8": 1, "i16": 2, "u16": 2, "char": 2, "i32": 4, "u32": 4, "i64": 8}


def encode_integer(value: Column, kind: str) -> Column:
    n = WIDTHS[kind]
    shown = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n))
    return F.unhex(F.concat(*(F.substring(shown, 2 * i + 1, 2) for i in reversed(range(n)))))


def decode_integer(raw: Column, kind: str) -> Column:
    n = WIDTHS[kind]
    shown = F.hex(raw)
    turned = F.concat(*(F.substring(shown, 2 * i + 1, 2) for i in reversed(range(n))))
    if kind == "i64":
        high, low = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)
    number = F.conv(turned, 16, 10).cast("long")
    if kind.startswith("i"):
        return F.when(number >= 1 << (8 * n - 1), number - (1 << (8 * n))).otherwise(number)
    return number


def encode_bool(value: Column) -> Column:
    return F.when(value, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))


def decode_bool(raw: Column) -> Column:
    return F.hex(raw) != "00"


def encode_string(value: Column, charset: str = "UTF-8") -> Column:
    """A null string is an error, as bytes can't say it."""
    return F.encode(F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("null string"))), charset)


def decode_string(raw: Column, charset: str = "UTF-8") -> Column:
    return F.decode(raw, charset)


def encode_nullable(value: Column, encoded: Column) -> Column:
    """00 for null, 01 and the value's bytes otherwise."""
    return F.when(value.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), encoded))


def decode_nullable(raw: Column, decoder) -> Column:
    return F.when(F.hex(F.substring(raw, 1, 1)) != "00", decoder(F.substring(raw, 2, 2**31 - 1)))


def encode_json(value: Column) -> Column:
    return F.encode(F.to_json(value), "UTF-8")


def decode_json(raw: Column, schema: T.DataType | str) -> Column:
    return F.from_json(F.decode(raw, "UTF-8"), schema)


def encode_micros(value: Column) -> Column:
    """A timestamp as its microseconds since 1970."""
    return encode_integer(F.unix_micros(value), "i64")


def decode_micros(raw: Column) -> Column:
    return F.timestamp_micros(decode_integer(raw, "i64"))


def encode_float(value: Column, double: bool = True) -> Column:
    """IEEE little-endian; NaN, infinities and signed zeros survive."""
    form = "<d" if double else "<f"

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: struct.pack(form, x))

    return run(value)


def decode_float(raw: Column, double: bool = True) -> Column:
    form = "<d" if double else "<f"

    @F.pandas_udf("double" if double else "float")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: struct.unpack(form, x)[0])

    return run(raw)


def encode_decimal(value: Column) -> Column:
    """Sixteen bytes: 96 bits of digits in three words, then scale and sign; trailing zeros are kept if they fit."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(x: decimal.Decimal) -> bytes:
            sign, figures, exponent = x.as_tuple()
            number, exponent = int("".join(map(str, figures))) * 10 ** max(0, exponent), min(0, exponent)
            while number >= 1 << 96 and exponent and number % 10 == 0:  # zeros that only the column's scale adds
                number, exponent = number // 10, exponent + 1
            if number >= 1 << 96 or -exponent > 28:
                raise ValueError(f"{x} doesn't fit in 96 bits and 28 places")
            flags = (-exponent << 16) | (sign << 31)
            return struct.pack("<IIII", number & 0xFFFFFFFF, number >> 32 & 0xFFFFFFFF, number >> 64, flags)

        return s.map(one, na_action="ignore")

    return run(value)


def decode_decimal(raw: Column, scale: int = 18) -> Column:
    @F.pandas_udf(T.DecimalType(38, scale))
    def run(s: pd.Series) -> pd.Series:
        def one(x: bytes) -> decimal.Decimal:
            low, mid, high, flags = struct.unpack("<IIII", x)
            number = decimal.Decimal(low | mid << 32 | high << 64).scaleb(-(flags >> 16 & 0xFF), decimal.Context(prec=60))
            return number.copy_negate() if flags >> 31 else number

        return s.map(one, na_action="ignore")

    return run(raw)


def encode_guid(value: Column) -> Column:
    """Sixteen bytes; the first three groups are little-endian."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: uuid.UUID(x).bytes_le, na_action="ignore")

    return run(value)


def decode_guid(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: str(uuid.UUID(bytes_le=bytes(x))), na_action="ignore")

    return run(raw)


# Ticks are 100 ns, counted from year 1; types of keys and values.
TICKS_PER_MICRO, EPOCH_MICROS = 10, 62_135_596_800_000_000
KEY_KINDS = {"normal": 0, "list_node": 1, "set_node": 2, "set_sentinel": 3}


def encode_char(value: Column) -> Column:
    """One character as a 16-bit unit."""
    return encode_integer(F.ascii(value), "char")


def decode_char(raw: Column) -> Column:
    return F.decode(F.unhex(F.concat(F.substring(F.hex(raw), 3, 2), F.substring(F.hex(raw), 1, 2))), "UTF-16BE")


def encode_datetime(value: Column, utc: bool = True) -> Column:
    """A timestamp as ticks, with the two high bits saying what it is: 1 for UTC, 0 for unspecified."""
    ticks = (F.unix_micros(value) + F.lit(EPOCH_MICROS)) * F.lit(TICKS_PER_MICRO)
    return encode_integer(ticks.bitwiseOR(F.lit(1 << 62 if utc else 0)), "i64")


def decode_datetime(raw: Column) -> Column:
    """Parts of a microsecond are lost."""
    ticks = decode_integer(raw, "i64").bitwiseAND(F.lit((1 << 62) - 1))
    return F.timestamp_micros(_micros(ticks) - F.lit(EPOCH_MICROS))


def _micros(ticks: Column) -> Column:
    """Whole microseconds; the exact quotient, as doubles can't hold so many ticks."""
    return F.call_function("div", ticks - F.pmod(ticks, F.lit(TICKS_PER_MICRO)), F.lit(TICKS_PER_MICRO).cast("long"))


def encode_timespan(micros: Column) -> Column:
    return encode_integer(micros * F.lit(TICKS_PER_MICRO), "i64")


def decode_timespan(raw: Column) -> Column:
    return _micros(decode_integer(raw, "i64"))


def encode_key(key: Column, kind: str = "normal") -> Column:
    """A key of a keyspace: a byte for its kind, then its bytes."""
    return F.concat(F.lit(bytes([KEY_KINDS[kind]])), key.cast("binary"))


def decode_key(raw: Column) -> Column:
    """struct<kind: int, key: binary>"""
    kind = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    return F.struct(kind.alias("kind"), F.substring(raw, 2, 2**31 - 1).alias("key"))


def encode_value(kind: Column, payload: Column, expires_ticks: Column) -> Column:
    """A value of a keyspace: a byte for its type, the expiry as ticks (-1 never), then the payload."""
    expiry = encode_integer(F.coalesce(expires_ticks, F.lit(-1).cast("long")), "i64")
    return F.concat(encode_integer(kind, "u8"), expiry, payload)


def decode_value(raw: Column) -> Column:
    """struct<kind: int, expires_ticks: long, payload: binary>"""
    kind = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    ticks = decode_integer(F.substring(raw, 2, 8), "i64")
    return F.struct(kind.alias("kind"), F.when(ticks != -1, ticks).alias("expires_ticks"), F.substring(raw, 10, 2**31 - 1).alias("payload"))


def encode_msgpack(value: Column) -> Column:
    """A struct, map or array, taken through JSON, as MessagePack."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        from keyloom.functions import msgpack

        return s.map(lambda x: msgpack.packed(json.loads(x)), na_action="ignore")

    return run(F.to_json(value))


def decode_msgpack(raw: Column, schema: T.DataType | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        from keyloom.functions import msgpack

        return s.map(lambda x: json.dumps(msgpack.unpacked(bytes(x))), na_action="ignore")

    return F.from_json(run(raw), schema)
