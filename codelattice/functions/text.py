"""Names, paths and short texts as Column expressions. A null input gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(qualified: Column) -> Column:
    """What stands behind the last `::`; the whole name without one."""
    return F.element_at(F.split(qualified, "::"), -1)


def file_part(qualified: Column) -> Column:
    """What stands before the first `::`."""
    return F.substring_index(qualified, "::", 1)


def folder(path: Column) -> Column:
    """The path up to its last slash, empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def normpath(path: Column) -> Column:
    """The path without `.`, empty parts and what `..` takes back; leading `..` stay, but for those of a path from the root. Nothing left is `.`."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        back = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return (
            F.when(part.isin("", "."), kept)
            .when((part == "..") & back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when((part == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    plain = F.array_join(F.reduce(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), plain)).when(plain == "", ".").otherwise(plain)


def ancestors(path: Column) -> Column:
    """The folders above a path, nearest first, down to the empty one (the root)."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def tails(path: Column) -> Column:
    """The path and what stands behind each of its slashes, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def stem(path: Column) -> Column:
    """The last part without its suffix; a leading dot belongs to the name."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The suffix in lower case with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def page_slug(path: Column) -> Column:
    """Slashes become dots and `.py` goes; an empty path is `root`."""
    plain = F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), "\\.py$", "")
    return F.when(plain == "", "root").otherwise(plain)


def file_slug(text: Column) -> Column:
    """Anything but letters, digits, `_`, `.` and `-` becomes `-`."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "-")


def humanized(test: Column) -> Column:
    """A test's name as words: without `test_`, split at underscores and capitals, in lower case."""
    words = F.regexp_replace(F.regexp_replace(test, "^(test_|Test)", ""), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.trim(F.lower(F.regexp_replace(words, "_+", " ")))


def relative(path: Column, root: str) -> Column:
    """The path without root where it lies below it; a `::` tail stays."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def summary(doc: Column, most: int = 120) -> Column:
    """The first line of a text, `most` characters at most."""
    return F.left(F.trim(F.split_part(F.trim(doc), F.lit("\n"), F.lit(1))), F.lit(most))


def clipped(text: Column, most: int) -> Column:
    """White space runs as one space; a longer text ends in an ellipsis and has `most` characters in all."""
    plain = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.char_length(plain) > most, F.concat(F.rtrim(F.left(plain, F.lit(most - 1))), F.lit("…"))).otherwise(plain)


def gauge(part: Column, whole: Column, cells: int = 20) -> Column:
    """A bar of filled and empty cells; some part shows one filled cell at least. Without a whole all are empty."""
    full = F.when((whole > 0) & (part > 0), F.greatest(F.lit(1), F.floor(cells * part / whole))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))


def delta(n: Column) -> Column:
    """A signed number; empty for 0 and null."""
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).when(n < 0, n.cast("string")).otherwise("")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 without a whole."""
    return F.when(whole > 0, F.floor(100 * part / whole)).otherwise(0).cast("long")


def links(markdown: Column) -> Column:
    """Targets of `[label](target)` links."""
    return F.regexp_extract_all(markdown, F.lit("\\[[^\\]]*\\]\\(([^)\\s]+)\\)"), F.lit(1))


def short_hash(text: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of a text."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))
