"""Scalar checks as column expressions; text without a JVM form as Arrow functions in :mod:`.canonical`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_text(data: Column) -> Column:
    """Bytes as text, null where they are not UTF-8."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def int64(text: Column) -> Column:
    """Value of a canonical decimal string, else null: one spelling each, no sign but a minus, in range."""
    return F.when(text.rlike(r"\A(?:0|-?[1-9][0-9]*)\z"), text.try_cast("bigint"))


def uint64(text: Column) -> Column:
    """DECIMAL(20,0) of a canonical unsigned decimal string up to 2^64 - 1, else null."""
    value = F.when(text.rlike(r"\A(?:0|[1-9][0-9]*)\z"), text.try_cast("decimal(38,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value.cast("decimal(20,0)"))


def is_sha256(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{64}\z")


def is_pseudonym(text: Column) -> Column:
    return text.rlike(r"\AP[0-9]{3,6}\z")


def path_error(path: Column) -> Column:
    """Why a relative path is not safe, null if it is."""
    return (
        F.when(path.isNull() | (path == "") | path.rlike(r"\A\s|\s\z"), "empty_or_padded")
        .when(path.contains("\\") | path.contains("\0"), "illegal_character")
        .when(path.startswith("/"), "absolute")
        .when(F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), "empty_or_traversal_segment")
    )


def version_major(version: Column) -> Column:
    return F.element_at(F.split(version, r"\."), 1).try_cast("int")


def artifact_path(kind: Column, chunk_id: Column) -> Column:
    """Path of a chunk's artifact inside its stream."""
    suffix = F.when(kind == "payloads", "bin").otherwise("arrow")
    return F.concat(kind, F.lit("/"), F.format_string("%06d", chunk_id.cast("bigint")), F.lit("."), suffix)


def file_stem(name: Column) -> Column:
    """Letters, digits, - and _ of a name; everything else becomes _."""
    return F.regexp_replace(name, r"[^\p{Alnum}_-]", "_")


def label_key(label: Column) -> Column:
    """A label without case and underscores, for comparison."""
    return F.replace(F.lower(label), F.lit("_"), F.lit(""))


def incomplete_marker(name: Column) -> Column:
    return name.endswith(".part") | name.endswith(".tmp") | name.endswith(".open")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def epoch_ns(ts: Column) -> Column:
    return epoch_micros(ts) * 1000
