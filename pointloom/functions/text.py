"""Names, paths and small structures in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """name without its last extension; a name without a dot stays (the extension counts from the base name)."""
    return F.regexp_replace(name, r"\.[^./]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def numbered(i: Column, digits: int = 5, extension: str = ".png") -> Column:
    return F.concat(F.lpad(i.cast("string"), digits, "0"), F.lit(extension))


def fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def is_comment(line: Column) -> Column:
    return F.trim(line).startswith("#")


def every(array: Column, step: int, start: int = 0) -> Column:
    """Items start, start + step, ... of an array."""
    return F.filter(array, lambda _, i: (i >= start) & ((i - start) % step == 0))


def suffix_number(name: Column, prefix: str) -> Column:
    """The number after prefix_, NULL for other names."""
    return F.when(name.startswith(f"{prefix}_"), F.substring_index(name, "_", -1).try_cast("int"))


def in_suffix_order(names: list[str], prefix: str) -> list[str]:
    """Column names of one prefix by numeric suffix: f_9 before f_10."""
    mine = [n for n in names if n.startswith(f"{prefix}_")]
    return sorted(mine, key=lambda n: int(n.rsplit("_", 1)[1]))


def log_label(t: Column) -> Column:
    """Day, month and time as log lines show them."""
    return F.date_format(t, "dd/MM HH:mm:ss")


def renamed_keys(m: Column, old: str, new: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.replace(k, F.lit(old), F.lit(new)))


def run_id(key: Column, digits: int = 10) -> Column:
    """A short name for a run, the same for the same key: the start of its digest."""
    return F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, digits)
