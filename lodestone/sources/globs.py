"""Gitignore-style patterns as column predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


@dataclass(frozen=True)
class Glob:
    """One pattern: a regular expression for a whole relative path, and how it counts."""

    regex: str
    negated: bool
    dir_only: bool


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c


def _segment(seg: str) -> str:
    out, i = "", 0
    while i < len(seg):
        c = seg[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := seg.find("]", i + 2)) > 0:
            body = seg[i + 1 : end]
            inverse = body[0] in "!^"
            body = body[1:] if inverse else body
            out += "[" + ("^/" if inverse else "") + "".join("-" if x == "-" else _literal(x) for x in body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(seg):
            i += 1
            out += _literal(seg[i])
        else:
            out += _literal(c)
        i += 1
    return out


def compile_glob(pattern: str) -> Glob | None:
    """None for blank lines and comments."""
    text = pattern.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text.strip() or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    dir_only = text.endswith("/")
    text = text.rstrip("/") if dir_only else text
    anchored = "/" in text
    parts = [p for p in text.split("/") if p]
    if not parts:
        return None
    regex = "" if anchored and parts[0] != "**" else "(?:.*/)?"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            regex += ".+" if last else "(?:.*/)?" if i else ""
        else:
            regex += _segment(p) + ("" if last else "/")
    return Glob(f"(?is)^{regex}$", negated, dir_only)


def compile_globs(patterns: Sequence[str]) -> list[Glob]:
    return [g for p in patterns if (g := compile_glob(p))]


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether relative paths are ignored: a file if it or a directory above it is,
    each by the last pattern that matches. An ignored directory can't be re-included in part."""
    globs = compile_globs(patterns)
    if not globs:
        return F.lit(False)
    parts = F.split(path, "/", -1)

    def test(i: Column) -> Column:
        prefix, is_dir = F.array_join(F.slice(parts, 1, i), "/"), i < F.size(parts)
        hit = lambda g: F.regexp_like(prefix, F.lit(g.regex)) & (is_dir if g.dir_only else F.lit(True))
        return reduce(lambda rest, g: F.when(hit(g), not g.negated).otherwise(rest), globs, F.lit(False))

    if not any(g.negated or g.dir_only for g in globs):
        whole = "|".join(g.regex.removeprefix("(?is)^").removesuffix("$") for g in globs)
        return F.regexp_like(path, F.lit(f"(?is)^(?:{whole})(?:/.*)?$"))
    return F.exists(F.sequence(F.lit(1), F.size(parts)), test)


def relative_to(path: Column, root: str) -> Column:
    """Path below a root, or null if it isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30))


def excluded_by_roots(path: Column, roots: Sequence[str], patterns: Sequence[str]) -> Column:
    """Whether a path below any root is ignored relative to it; outside all roots it isn't."""
    tests = [F.coalesce(ignored(relative_to(path, r), patterns), F.lit(False)) for r in roots]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def find_glob(files: DataFrame, glob: str, cwd: str, path_col: str = "path") -> DataFrame:
    """Paths that match a pattern relative to ``cwd``, or by base name outside it; sorted."""
    path = F.col(path_col)
    candidate = F.coalesce(relative_to(path, cwd), F.substring_index(path, "/", -1))
    return files.where(ignored(candidate, [glob])).select(path_col).orderBy(path_col)
