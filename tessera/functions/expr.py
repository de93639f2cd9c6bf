"""Column builders: CBOR heads and documents, digests, byte differences, varints, multibase. All are native expressions inside generated code.

Binary columns are handled as hex pairs where single bytes matter; integers outside the stated range give null or an error as said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.cbor import head as head_bytes
from ..kernels.cbor import key_order


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def octets(c: Column) -> Column:
    """The bytes of a string or binary column."""
    return c.cast("binary")


def head(major: int, n: Column) -> Column:
    """The head of an item with argument n (0 <= n < 2^63)."""
    of = lambda info, width: F.concat(F.lit(f"{32 * major + info:02X}"), F.lpad(F.hex(n), 2 * width, "0"))
    small = F.lpad(F.hex(n + 32 * major), 2, "0")
    return F.unhex(F.when(n < 24, small).when(n < 1 << 8, of(24, 1)).when(n < 1 << 16, of(25, 2)).when(n < 1 << 32, of(26, 4)).otherwise(of(27, 8)))


def item(c: Column, kind: T.DataType) -> Column:
    """A scalar, struct or array column as one CBOR item; null is CBOR null. Doubles have no native form here."""
    if isinstance(kind, T.StringType):
        out = F.concat(head(3, F.octet_length(c).cast("long")), octets(c))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(head(2, F.octet_length(c).cast("long")), c)
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, raw(b"\xf5")).otherwise(raw(b"\xf4"))
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        n = c.cast("long")
        out = F.when(n >= 0, head(0, n)).otherwise(head(1, F.bitwise_not(n)))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: F.hex(item(x, kind.elementType)))
        out = F.concat(head(4, F.size(c).cast("long")), F.unhex(F.array_join(items, "")))
    elif isinstance(kind, T.StructType):
        return F.when(c.isNull(), raw(b"\xf6")).otherwise(document({f.name: (c[f.name], f.dataType) for f in kind}))
    else:
        raise TypeError(f"{kind.simpleString()} has no native CBOR form; use the Arrow encoder")
    return F.when(c.isNull(), raw(b"\xf6")).otherwise(out)


def document(fields: dict[str, tuple[Column, T.DataType]], mode: str = "lengthFirstDeterministic") -> Column:
    """A map of named columns. Keys are encoded and ordered here, once; at run time only the values are."""
    order = key_order(mode)
    keys = sorted(((head_bytes(3, len(k.encode())) + k.encode(), v) for k, v in fields.items()), key=lambda e: order(e[0]))
    return F.concat(raw(head_bytes(5, len(keys))), *[F.concat(raw(k), item(c, t)) for k, (c, t) in keys])


def envelope(payload: Column, registry_id: int = 0) -> Column:
    """The 1.0 envelope: a tag over [registry id, payload]."""
    return F.concat(raw(b"\xd9\xcb\x1d\x82" + head_bytes(0, registry_id)), payload)


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(octets(c), 256))


def state_words(c: Column) -> Column:
    """The eight 32-bit words of a SHA-256 digest, most significant first."""
    h = F.sha2(octets(c), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))


def pairs(c: Column) -> Column:
    """The bytes as an array of two hex digits each."""
    return F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))


def byte_diff(left: Column, right: Column) -> Column:
    """struct(left_bytes, right_bytes, mismatches, first_mismatch): bytes that differ, the longer side's excess included. Equal sides are not taken apart."""
    d = F.zip_with(pairs(left), pairs(right), lambda a, b: ~a.eqNullSafe(b))
    long = lambda x: x.cast("long")
    return F.struct(
        long(F.octet_length(left)).alias("left_bytes"),
        long(F.octet_length(right)).alias("right_bytes"),
        F.when(left == right, F.lit(0)).otherwise(long(F.size(F.filter(d, lambda x: x)))).cast("long").alias("mismatches"),
        F.when(left == right, F.lit(None)).otherwise(F.nullif(long(F.array_position(d, True)), F.lit(0)) - 1).cast("long").alias("first_mismatch"),
    )


def key_permutation(keys: Column, mode: str = "lengthFirstDeterministic") -> Column:
    """The stable order of an array of binary keys, as indices."""
    if mode == "coreDeterministic":
        tagged = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    else:
        tagged = F.transform(keys, lambda k, i: F.struct(F.octet_length(k).alias("n"), k.alias("k"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda x: x["i"])


def multibase(c: Column, kind: str) -> Column:
    """Base64 without padding behind its prefix: ``u`` (URL alphabet) or ``M``."""
    plain = F.rtrim(F.regexp_replace(F.base64(octets(c)), r"\s", ""), F.lit("="))
    return F.concat(F.lit(kind), F.translate(plain, "+/", "-_") if kind == "u" else plain)


def multibase_decode(c: Column) -> Column:
    """The bytes of a ``u`` or ``M`` value; null for any fault. Alphabet and length are checked before decoding."""
    body = F.substr(c, F.lit(2))
    n = F.length(body)
    ok = (c.rlike("^u[A-Za-z0-9_-]*$") | c.rlike("^M[A-Za-z0-9+/]*$")) & (n % 4 != 1)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), ((F.lit(4) - n % 4) % 4).cast("int")))
    return F.when(ok, F.try_to_binary(padded, F.lit("base64")))


def varint(n: Column) -> Column:
    """Unsigned LEB128 of 0 <= n < 2^63; null below."""
    step = lambda i: F.shiftrightunsigned(n, 7 * i)
    last = lambda i: step(i + 1) == 0 if i < 8 else F.lit(True)
    digit = lambda i: F.lpad(F.hex(F.when(last(i), step(i).bitwiseAND(127)).otherwise(step(i).bitwiseAND(127).bitwiseOR(128))), 2, "0")
    digits = [digit(0), *[F.when(step(i) != 0, digit(i)).otherwise(F.lit("")) for i in range(1, 9)]]
    return F.when(n >= 0, F.unhex(F.concat(*digits)))


def varint_value(c: Column) -> Column:
    """The number of a LEB128 column of up to nine bytes; null if it does not end with the data."""
    n = F.octet_length(c)
    text = F.decode(c, "ISO-8859-1")  # a character a byte
    digits = [F.ascii(F.substring(text, i + 1, 1)).cast("long") for i in range(9)]  # 0 beyond the end
    fine, total = (n > 0) & (n <= 9), digits[0].bitwiseAND(127)
    for i, d in enumerate(digits):
        fine = fine & ((d >= 128) == (n > i + 1))
        total = total.bitwiseOR(F.shiftleft(d.bitwiseAND(127), 7 * i)) if i else total
    return F.when(fine, total)


def fingerprint(canonical: Column, domain: str, version: int = 1) -> Column:
    """The domain-separated SHA-256 of canonical bytes."""
    return F.sha2(F.concat(raw(b"CBOR-LD\0" + domain.encode() + b"\0" + bytes([version])), canonical), 256)


def uuid_bytes(c: Column) -> Column:
    """16 bytes of a lower-case UUID; null for anything else."""
    return F.when(c.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.unhex(F.replace(c, F.lit("-"))))


def uuid_text(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def date_seconds(c: Column) -> Column:
    """Seconds since 1970 of a yyyy-MM-dd text that comes back the same; null else."""
    d = F.try_to_date(c)
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$") & (d.cast("string") == c), F.unix_date(d).cast("long") * 86400)


def url_parts(c: Column) -> Column:
    """struct(code, rest): the scheme's code and what follows, for the two web schemes; code 0 keeps the text."""
    return (
        F.when(c.startswith("https://"), F.struct(F.lit(2).alias("code"), F.substr(c, F.lit(9)).alias("rest")))
        .when(c.startswith("http://"), F.struct(F.lit(1).alias("code"), F.substr(c, F.lit(8)).alias("rest")))
        .otherwise(F.struct(F.lit(0).alias("code"), c.alias("rest")))
    )


def digest_text(algorithm: str, domain: str, version: int, digest: Column) -> Column:
    return F.concat_ws(":", F.lit(algorithm), F.lit(domain), F.lit(f"v{version}"), F.lower(F.hex(digest)))


def digest_parts(c: Column) -> Column:
    """struct(algorithm, domain, version, bytes) of a digest's text; null where it is not one or its length is not the algorithm's."""
    part = F.split(c, ":")
    size = F.when(part[0] == "sha256", 64).when(part[0] == "sha384", 96).when(part[0] == "sha512", 128)
    sound = c.rlike("^sha(256|384|512):[a-z-]+:v[1-9][0-9]*:[0-9a-f]+$") & (F.length(part[3]) == size)
    return F.when(sound, F.struct(part[0].alias("algorithm"), part[1].alias("domain"), F.substr(part[2], F.lit(2)).cast("int").alias("version"), F.unhex(part[3]).alias("bytes")))
