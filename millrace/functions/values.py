"""Hash splits, canonical JSON, exact amounts, sortable ids, timestamps, checks of JSON: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col


def unit_interval(key: Column | str) -> Column:
    """A number in [0, 1] from the first 32 bits of a key's SHA-256; null keys give null."""
    return F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def hash_split(key: Column | str, train: float = 0.8, validation: float = 0.1) -> Column:
    """train, validation or test by the key's hash; the same key always falls in the same part."""
    u = unit_interval(key)
    return F.when(u < train, "train").when(u < train + validation, "validation").when(u.isNotNull(), "test")


def seeded_split(key: Column | str, seed: int = 20260926, validation: float = 0.05, test: float = 0.05) -> Column:
    """validation, test or train by the first byte of the hash of seed and key."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256), 1, 2), 16, 10).cast("int") / F.lit(255.0)
    return F.when(u < validation, "validation").when(u < validation + test, "test").when(u.isNotNull(), "train")


def parsed(c: Column | str) -> Column:
    """JSON text as VARIANT; null if it can't be parsed.

    The built-in parser stops after the first value and takes no notice of
    what follows; here the text is put in a list before a mark, so that
    anything but one whole value breaks the list.
    """
    mark = "\x02end"
    whole = F.try_parse_json(F.concat(F.lit("["), col(c), F.lit(',"\\u0002end"]')))
    alone = lambda x: F.when((F.size(x) == 2) & (F.try_variant_get(F.get(x, F.lit(1)), "$", "string") == mark), F.get(x, F.lit(0)))
    return bound(F.try_variant_get(whole, "$", "array<variant>"), alone)


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys and without blanks; null if it can't be parsed."""
    return F.to_json(parsed(c))


def stable_hash(c: Column | str) -> Column:
    return F.sha2(canonical_json(c), 256)


def minor_units(amount: Column | str, places: int = 2) -> Column:
    """An amount in its smallest unit as a whole number; null where it has more places."""
    x = col(amount).cast(f"decimal(28,{places + 8})")
    scaled = (x * F.lit(10**places)).cast(f"decimal(38,{8})")
    return F.when(scaled == F.floor(scaled), scaled.cast("bigint"))


def scaled(minor: Column | str, numerator: int, denominator: int) -> Column:
    """A whole amount times a ratio, cut towards zero."""
    product = col(minor).cast("decimal(38,0)") * F.lit(numerator).cast("decimal(19,0)")
    return F.when(product >= 0, F.floor(product / denominator)).otherwise(F.ceil(product / denominator)).cast("bigint")


def instant(c: Column | str) -> Column:
    """Timestamp of ISO-8601 text; UTC where it names no offset; null if it can't be read."""
    x = F.trim(col(c))
    return F.when(x.rlike(r"(Z|z|[+-]\d\d:?\d\d)$"), x).otherwise(F.concat(x, F.lit("Z"))).try_cast("timestamp")


def document_id(uri: Column | str) -> Column:
    """32 hexadecimal digits of the SHA-256 of the address without outer blanks."""
    return F.substring(F.sha2(F.trim(col(uri)), 256), 1, 32)


def canonical_category(c: Column | str) -> Column:
    """Upper case with underscores, three aliases replaced."""
    x = F.translate(F.upper(F.trim(col(c))), "- ", "__")
    # Aliases of categories.
    aliases = {"AGENT_TRAJECTORIES": "AGENT_TRAJECTORY", "WEB_TASKS": "WEB_TASK", "TOOL_USAGE": "TOOL_USE"}
    out = x
    for plural, single in aliases.items():
        out = F.when(x == plural, single).otherwise(out)
    return out


# Amounts


def added(a: Column | str, b: Column | str, currency_a: Column | str, currency_b: Column | str) -> Column:
    """Sum of two whole amounts; null where the currencies differ."""
    return F.when(col(currency_a) == col(currency_b), F.try_add(col(a), col(b)))


def currency(c: Column | str) -> Column:
    """A currency's name without outer blanks; null unless it has 1 to 16 characters. Letter case is kept."""
    x = F.trim(col(c))
    return F.when(F.length(x).between(1, 16), x)


# Sortable ids: prefix, milliseconds, sequence and chance


def is_sortable_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[a-z][a-z0-9_]*_[0-9]{13}_[0-9a-f]{12}$"), F.lit(False))


def id_seconds(c: Column | str) -> Column:
    """Seconds since 1970 at which an id was made; 0 if it isn't one."""
    return F.when(is_sortable_id(c), F.regexp_extract(col(c), r"(?:^|_)([0-9]{13})(?:_|$)", 1).cast("double") / 1000).otherwise(0.0)


def sortable_id(prefix: str, at: Column, sequence: Column, chance: Column | str) -> Column:
    """An id from an instant, a number within its millisecond, and the hash of a value (so that it is the same in every run)."""
    return F.concat_ws("_", F.lit(prefix), F.lpad(F.unix_millis(at.cast("timestamp")).cast("string"), 13, "0"), F.concat(F.lpad(F.lower(F.hex(sequence)), 6, "0"), F.substring(F.sha2(col(chance).cast("string"), 256), 1, 6)))


def expired(at: Column | str, hours: float, as_of: Column) -> Column:
    """Whether so many hours have gone since an instant; false for null."""
    return F.coalesce(F.unix_micros(col(at).cast("timestamp")) + int(hours * 3_600_000_000) <= F.unix_micros(as_of), F.lit(False))


# Names and addresses


def has_prefix(uri: Column | str, prefix: str) -> Column:
    """Whether an address begins so, ASCII letter case aside; wildcards mean themselves."""
    return F.coalesce(F.lower(F.substring(col(uri), 1, len(prefix))) == prefix.lower(), F.lit(False))


def subset_of(path: Column | str) -> Column:
    """The innermost folder of a path that isn't one of the usual stages; the file's name without ending if there is none."""
    # Names of stages.
    parts = F.split(col(path), "/")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("raw", "staging", "processed", "datasets", ""))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.try_element_at(folders, F.lit(-1)), stem)


def is_dataset_id(c: Column | str) -> Column:
    """owner/name, neither empty nor a dot."""
    parts = F.split(col(c), "/")
    return F.coalesce((F.size(parts) == 2) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def is_source_file(c: Column | str) -> Column:
    """A relative path with forward slashes that doesn't climb."""
    x = col(c)
    return F.coalesce((x != "") & ~x.startswith("/") & ~x.contains("\\") & ~F.array_contains(F.split(x, "/"), ".."), F.lit(False))


def limit_left(cap: int, seen: int) -> int | None:
    """How many more records a run may take; None for no cap (0). Negative caps are an error."""
    if not isinstance(cap, int) or isinstance(cap, bool) or cap < 0:
        raise ValueError("a cap must be a whole number, 0 or more")
    return None if cap == 0 else max(0, cap - seen)


# Checks of JSON against a schema

_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def schema_problem(value: Column, schema: dict, path: str = "input") -> Column:
    """The first way in which a VARIANT breaks a JSON schema (type, enum, minLength, maxLength, required, additionalProperties, properties, items); null if none.

    The schema is turned into one expression, so checks run in the JVM.  A null
    VARIANT has no type.
    """
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))
    whole, number = kind.isin("BIGINT"), kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    is_type = lambda t: whole if t == "integer" else number if t == "number" else kind == _TYPES[t]
    text, found = F.try_variant_get(value, "$", "string"), []
    if (wanted := schema.get("type")) is not None:
        names = sorted(wanted if isinstance(wanted, list) else [wanted])
        fits = is_type(names[0])
        for t in names[1:]:
            fits = fits | is_type(t)
        found.append(F.when(~fits, f"{path} must have type {', '.join(names)}"))
    if "enum" in schema:
        found.append(F.when(~F.coalesce(text.isin([str(x) for x in schema["enum"]]), F.lit(False)), f"{path} is not an allowed value"))
    for key, short in (("minLength", True), ("maxLength", False)):
        if key in schema:
            off = F.length(text) < schema[key] if short else F.length(text) > schema[key]
            found.append(F.when((kind == "STRING") & off, f"{path} is too {'short' if short else 'long'}"))
    part = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    object_ = kind == "OBJECT"
    found += [F.when(object_ & part(name).isNull(), f"{path}.{name} is required") for name in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(F.when(object_, value)))
        unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")))
        found.append(F.when(F.size(unknown) > 0, F.concat(F.lit(f"{path} contains unknown fields: "), F.array_join(unknown, ", "))))
    found += [F.when(object_ & part(name).isNotNull(), schema_problem(part(name), own, f"{path}.{name}")) for name, own in schema.get("properties", {}).items()]
    if isinstance(schema.get("items"), dict):
        items = F.when(kind == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))
        mark = "\ue000"
        each = F.transform(items, lambda x, i: F.replace(schema_problem(x, schema["items"], f"{path}[{mark}]"), F.lit(mark), i.cast("string")))
        found.append(F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")
