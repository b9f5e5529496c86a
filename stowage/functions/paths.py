"""Path, hash and size expressions; all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_path(uri: Column) -> Column:
    """The path of a file URI."""
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def dir_name(path: Column) -> Column:
    return F.when(path.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``; null if it isn't."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def restore_path(path: Column, requested: Column, target: Column) -> Column:
    """Where a file of a restored directory goes: below the target, or with the root stripped if it isn't below the request."""
    below = F.coalesce(relative_path(path, requested), F.when(path == requested, base_name(path)), F.regexp_replace(path, "^/+", ""))
    return F.concat(F.regexp_replace(target, "/+$", ""), F.lit("/"), below)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(text: Column, *pattern: Column) -> Column:
    """LIKE regardless of the case of A-Z; ``%`` and ``_`` of any part are wildcards, a backslash is itself."""
    folded = F.replace(F.translate(F.concat(*pattern), UPPER, LOWER), F.lit("\\"), F.lit("\\\\"))
    return F.like(F.translate(text, UPPER, LOWER), folded)


def ends_with(text: Column, part: Column) -> Column:
    """Suffix match by ``like``."""
    return like(text, F.lit("%"), part)


def contains(text: Column, part: Column) -> Column:
    """Substring match by ``like``."""
    return like(text, F.lit("%"), part, F.lit("%"))


def hashed_number(text: Column) -> Column:
    """60 bits of a text's hash as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def format_bytes(size: Column) -> Column:
    """A size in GB, MB, KB (two decimals) or B."""
    out = F.format_string("%d B", size.cast("long"))
    for name, power in (("KB", 10), ("MB", 20), ("GB", 30)):
        unit = 1 << power
        out = F.when(size >= unit, F.format_string(f"%.2f {name}", F.round(size / float(unit), 2))).otherwise(out)
    return out


def short_hash(value: Column) -> Column:
    """A hash for display: cut at 32 characters; blank ones are empty files."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("(empty file)")).when(F.length(value) > 32, F.concat(F.substring(value, 1, 32), F.lit("..."))).otherwise(value)


def permissions(mode: Column) -> Column:
    """The permission bits of a mode."""
    return mode.bitwiseAND(F.lit(0o777))


def content_hash(data: Column) -> Column:
    """SHA-256 in lowercase hexadecimal."""
    return F.sha2(data, 256)


def sealed_hash(plain_hash: Column, key: str) -> Column:
    """The name of a blob after encryption: a function of the key and the plain hash alone."""
    return F.sha2(F.concat(F.lit(key), plain_hash), 256)


def percentage(part: Column, whole: Column) -> Column:
    """100 x part / whole, 0 if there is no whole."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def rate_per_second(amount: Column, seconds: Column) -> Column:
    """Amount per second; no time counts as a millisecond."""
    return amount / F.when(seconds == 0, F.lit(0.001)).otherwise(seconds)
