"""Path expressions. All are native columns, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one folder name that is skipped besides hidden folders.
SKIPPED_FOLDERS = ("node_modules",)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    path = _col(path)
    head = F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)
    return (
        F.when(~path.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def parent_name(path: Column | str) -> Column:
    """Name of the folder that holds the file, ``''`` when there is none."""
    return F.coalesce(F.get(F.split(_col(path), "/"), F.size(F.split(_col(path), "/")) - 2), F.lit(""))


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[_col(p) for p in parts])


def suffix(name: Column | str) -> Column:
    """Last extension in its own case; a leading dot alone does not count."""
    return F.regexp_extract(_col(name), r"(?s)^.+(\.[^.]*)$", 1)


def stem(name: Column | str) -> Column:
    name = _col(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension(path: Column | str) -> Column:
    return F.lower(suffix(basename(path)))


def order_key(path: Column | str) -> Column:
    """Sort key of a directory walk: compares element by element.

    No path holds a zero byte, so putting one in place of ``/`` makes plain
    string order equal to the order of the split path, at half the shuffle size
    of an array and reversible with :func:`from_order_key`.
    """
    return F.replace(_col(path), F.lit("/"), F.lit("\0"))


def from_order_key(key: Column | str) -> Column:
    return F.replace(_col(key), F.lit("\0"), F.lit("/"))


def normalize_path(path: Column | str, default: str) -> Column:
    """Trim, resolve ``//``, ``.`` and ``..``, drop the last ``/``; blank becomes ``default``."""
    trimmed = F.trim(_col(path))
    absolute = trimmed.startswith("/")
    parts = F.filter(F.split(trimmed, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        climbs = part == ".."
        return (
            F.when(climbs & (F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .when(climbs & absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    clean = F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(default)).otherwise(clean)


def listed(path: Column | str, root: Column | str) -> Column:
    """True when a directory walk from ``root`` would report this file.

    Hidden files are reported; anything below a hidden or skipped folder is not.
    Folders above and including ``root`` do not matter.
    """
    path, root = _col(path), _col(root)
    below = F.substring(path, F.length(root) + 2, F.length(path))
    parts = F.split(below, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))
    return path.startswith(F.concat(root, F.lit("/"))) & ~hidden
