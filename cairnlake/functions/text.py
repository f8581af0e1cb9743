"""Sizes, validities, tags, paths, masks and timestamps as column expressions; null where the input is an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def parse_bytes(text: Column) -> Column:
    """``10MB``, ``1 g``, ``512K``, ``7`` as bytes."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^([+-]?[0-9]{1,18})\s*(?:[GMK]B?)?$", 1)
    unit = F.regexp_extract(t, r"([GMK])B?$", 1)
    scale = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1)
    return F.when(number != "", F.try_to_number(number, F.lit("S999999999999999999")).cast("long") * scale)


def validity_days(text: Column) -> Column:
    """``3 days``, ``2 months`` as days, from 1 to 365; a month is 30 days."""
    parts = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), " ")
    amount, unit = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.lower(F.try_element_at(parts, F.lit(2)))
    days = F.when(unit.startswith("day"), amount).when(unit.startswith("month"), amount * 30)
    return F.when((F.size(parts) == 2) & days.between(1, 365), days)


def _scaled(n: Column, power: int, places: int) -> Column:
    """``n`` / 2^``power``, which is 1 at least, with so many decimals; ties go to the even digit, as in C's printf, not up as in Java's."""
    x = n.cast("double") / float(1 << power)
    whole = F.floor(x)
    rest = ((x - whole) * float(1 << 52)).cast("long") * 10**places  # exact: a double of 1 or more has at most 52 bits of fraction
    digits, left, half = F.shiftright(rest, 52), rest.bitwiseAND(F.lit((1 << 52) - 1)), 1 << 51
    rounded = digits + ((left > half) | ((left == half) & (digits % 2 == 1))).cast("long")
    carried = whole + (rounded == 10**places).cast("long")
    return F.concat(carried.cast("string"), F.lit("."), F.lpad((rounded % 10**places).cast("string"), places, "0"))


def format_bytes(n: Column) -> Column:
    """1536 as ``1.5 KB``: one decimal, powers of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1 << 10 * k, F.concat(_scaled(n, 10 * k, 1), F.lit(f" {unit}B"))).otherwise(out)
    return out


def format_bytes_short(n: Column) -> Column:
    """1536 as ``1.5 KB``: two decimals without trailing zeros."""
    out = F.when(n == 0, "0 B").otherwise(F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        short = F.regexp_replace(_scaled(n, 10 * k, 2), r"\.?0+$", "")
        out = F.when(n >= 1 << 10 * k, F.concat(short, F.lit(f" {unit}"))).otherwise(out)
    return out


def encode_tags(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.to_json(tags)).otherwise("")


def decode_tags(text: Column) -> Column:
    """A JSON array of strings, else comma-separated words; null for an empty text."""
    listed = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    is_json = F.trim(text).rlike(r'^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    return F.when(text == "", None).when(is_json, F.from_json(text, "array<string>")).otherwise(listed)


def merge_tags(old: Column, new: Column) -> Column:
    """Both sides' tags, each once and sorted, as JSON; the other side as it is where one is empty."""
    both = F.array_sort(F.array_union(decode_tags(old), decode_tags(new)))
    return F.when(old == "", new).when(new == "", old).otherwise(encode_tags(F.filter(both, lambda x: x != "")))


def normal_path(path: Column) -> Column:
    parts = F.split(F.trim(F.regexp_replace(path, UUID, ":uuid"), F.lit("/")), "/")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), ":id").otherwise(x)), "/"))


def legacy_path(n: Column) -> Column:
    """12345 as ``12000/0000012345.bz2``."""
    return F.concat((n - n % 1000).cast("string"), F.lit("/"), F.lpad(n.cast("string"), 10, "0"), F.lit(".bz2"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_escape(text: Column) -> Column:
    """Percent-encoding of a path segment: unreserved characters and ``$&+=:@`` stay."""
    out = F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A")
    for code, char in (("%7E", "~"), ("%24", r"\$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
        out = F.regexp_replace(out, code, char)
    return out


def secret_masked(key: Column, value: Column) -> Column:
    k = F.lower(key)
    secret = k.rlike("password|passwd|secret|token") | (k.contains("key") & ~k.contains("key_path"))
    return F.when(secret & (value != ""), "********").otherwise(value)


def dsn_masked(dsn: Column) -> Column:
    at, scheme = F.instr(dsn, "@"), F.instr(dsn, "://")
    hidden = F.concat(F.substring(dsn, F.lit(1), scheme + 2), F.lit("****:****"), F.substring(dsn, at, F.length(dsn)))
    return F.when((at == 0) | (scheme == 0) | (at <= scheme + 3), dsn).otherwise(hidden)


def json_escaped(text: Column) -> Column:
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def timestamp_of(text: Column) -> Column:
    """ISO-like texts with or without a zone, or seconds since 1970, in UTC; null for anything else."""
    t = F.trim(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$")
    zoned = t.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    moment = F.when(zoned, F.to_utc_timestamp(t.try_cast("timestamp"), "UTC").cast("timestamp_ntz")).otherwise(t.try_cast("timestamp_ntz"))
    return F.when(iso, moment).when(t.rlike(r"^[+-]?\d{1,12}$"), F.timestamp_seconds(t.try_cast("long")).cast("timestamp_ntz"))
