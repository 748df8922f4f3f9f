"""Field-map access and attribute extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from runtime_insights import schema as S


def field(fields: Column, key: str) -> Column:
    """Value of ``key``; null when it is missing or null."""
    return F.try_element_at(fields, F.lit(key))


def has_field(fields: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, key), F.lit(False))


def field_if_present(fields: Column, key: str, default: str) -> Column:
    """``default`` only where the key is missing; a null value stays null."""
    # The key is looked for a second time only where the value is null.
    return F.coalesce(field(fields, key), F.when(~has_field(fields, key), F.lit(default)))


def label(fields: Column, key: str) -> Column:
    """Counter label: ``unknown`` for a missing key, the text ``None`` for a null."""
    return F.coalesce(field_if_present(fields, key, "unknown"), F.lit("None"))


def optional_label(fields: Column, key: str) -> Column:
    """Counter label that is ``none`` for a missing, null or empty value."""
    return F.coalesce(F.nullif(field(fields, key), F.lit("")), F.lit("none"))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only (any Unicode white space)."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def stripped(text: Column) -> Column:
    """The text without white space (any Unicode white space) around it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def command_tokens(cmdline: Column) -> Column:
    """Option tokens of a command line in order, duplicates kept."""
    return F.regexp_extract_all(cmdline, F.lit(S.TOKEN_PATTERN), F.lit(1))


def network_attribute(fd_name: Column, fd_type: Column) -> Column:
    """Remote end and protocol; null where the descriptor has no name."""
    sides = F.split(fd_name, "->")
    remote = F.when(F.size(sides) == 2, F.element_at(sides, 2)).otherwise(F.lit(":"))
    text = F.concat(remote, F.lit(":"), F.coalesce(fd_type, F.lit("")))
    return F.when(F.coalesce(fd_name, F.lit("")) != "", text)


def attribute(pos: Column, attr: Column, kind: str) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"), attr.alias("attr"), F.lit(kind).alias("attr_type")
    )


def file_attributes(fd_directory: Column, fd_name: Column) -> Column:
    """Directory, then name, each if not empty; the position tells which is which."""
    both = F.array(
        attribute(F.lit(0), fd_directory, S.DIRECTORY_TYPE),
        attribute(F.lit(1), fd_name, S.FILE_TYPE),
    )
    return F.filter(both, lambda a: F.coalesce(a["attr"], F.lit("")) != "")


def output_line(fields: Column, names: Sequence[str]) -> Column:
    """``key=value`` text of a rule's output template."""
    parts = []
    for name in names:
        value = F.coalesce(field(fields, name), F.lit(S.MISSING_FIELD))
        if name in S.BRACKETED_FIELDS:
            value = F.concat(F.lit("["), value, F.lit("]"))
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws(" ", *parts)


def keep_fields(fields: Column, names: Sequence[str]) -> Column:
    return F.map_filter(fields, lambda k, _: k.isin(*names))
