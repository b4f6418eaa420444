"""Column expressions on names, ids and paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(col: Column | str) -> Column:
    """An id without outer blanks (spaces, tabs), lower-cased; null stays null."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t")))


def dirname(path: Column) -> Column:
    """Everything before the last slash, '.' for a bare file name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    """Everything after the last slash."""
    return F.regexp_replace(path, "^.*/", "")


def package_path(path: Column, depth: int = 1) -> Column:
    """The first `depth` segments of a path; '.' for a root file. With few segments this can include the file name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def package_name(entity: Column) -> Column:
    """The part before the last slash, else before the last dot, else the id itself."""
    return (
        F.when(F.contains(entity, F.lit("/")), F.regexp_replace(entity, "/[^/]*$", ""))
        .when(F.contains(entity, F.lit(".")), F.regexp_replace(entity, r"\.[^.]*$", ""))
        .otherwise(entity)
    )


def dotted_package(entity: Column, depth: int) -> Column:
    """The first `depth` non-empty dot segments."""
    return F.array_join(F.slice(F.filter(F.split(entity, r"\."), lambda s: s != ""), 1, depth), ".")


def slug(path: Column) -> Column:
    """A file path as an id: runs of other characters become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-|-$", "")


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** crosses slashes, * and ? do not, {a,b} is a choice."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in r"\.+^$()[]|{}" else c)
        i += 1
    return "^" + "".join(out) + "$"
