"""Text functions: JSON escaping, addresses, status lists, key-value text and option values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that JSON output escapes, in order of replacement.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def json_escaped(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escaped(text), F.lit('"'))


def http_endpoint(url: Column) -> Column:
    """host, port (80 if none) and path ("/" if none) of an http URL; null for anything else."""
    form = r"^http://([^/:]+)(?::([0-9]{1,5}))?(/.*)?$"
    part = lambda k: F.regexp_extract(url, form, k)
    return F.when(
        url.rlike(form),
        F.struct(
            part(1).alias("host"),
            F.when(part(2) == "", 80).otherwise(F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("99999")).cast("int")).alias("port"),
            F.when(part(3) == "", "/").otherwise(part(3)).alias("path"),
        ),
    )


def status_codes(text: Column) -> Column:
    """Distinct HTTP status codes of a comma-separated list, sorted; entries that are none are left out."""
    codes = F.transform(F.split(text, ","), lambda c: F.when(F.trim(c).rlike("^[1-5][0-9]{2}$"), F.trim(c).cast("int")))
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())))


def key_values(text: Column, line: str = "\n") -> Column:
    """key=value lines as a map; the last of a key's values counts, lines without = are left out."""
    lines = F.filter(F.split(text, line), lambda x: x.contains("="))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.expr("0").alias("n"), F.substring(x, F.instr(x, "=") + 1, 2**31 - 1).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda z: z["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], F.trim(e["value"]))))


def true_value(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def metrics(line: Column) -> Column:
    """The name=number pairs of a benchmark line as a map."""
    names = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    values = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=(-?[0-9]+(?:\.[0-9]+)?)"), 2)
    return F.map_from_arrays(names, F.transform(values, lambda v: v.cast("double")))


# Headers that the sink sets itself.
RESERVED_HEADERS = ("host", "content-length", "content-type", "connection")


def header_valid(line: Column) -> Column:
    """Whether ``name: value`` is a header that may be added: a token as its name, none of the reserved, no line break."""
    name = F.lower(F.trim(F.substring_index(line, ":", 1)))
    return line.rlike("^[!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\\r\\n]*$") & ~name.isin(*RESERVED_HEADERS)


def headers(text: Column) -> Column:
    """Valid headers of a text with one per line, as a map of lower-case names; the last of a name counts."""
    return key_values(F.array_join(F.transform(F.filter(F.split(text, "\n"), header_valid), lambda x: F.concat(F.lower(F.substring_index(x, ":", 1)), F.lit("="), F.substring(x, F.instr(x, ":") + 1, 2**31 - 1))), "\n"))
