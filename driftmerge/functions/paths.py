r"""Path predicates: ignore rules with ``*``, ``?`` and ``**``.

A pattern with a slash is held against the whole path and each proper parent; one without, against every component.
``*`` and ``?`` stop at a slash, ``**`` crosses it; matches are anchored at both ends (``\A`` and ``\z``: a dollar
sign would accept a trailing line end). Rules become regular expressions that Catalyst can push through projections.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules that always hold: our metadata and temporary files, and those of common editors. Fixed values.
BUILT_IN = (".driftmerge", ".git", ".DS_Store", "*.swp", "*.swx", "*~", ".#*", "*.dmtmp*", "*.tmp")


def glob_regex(pattern: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("**", at):
            out.append("(?:.*)")
            at += 2
            continue
        c = pattern[at]
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        at += 1
    return "".join(out)


def ignored(path: Column, rules: list[str]) -> Column:
    """True where a rule matches the path. One expression for all rules of a sort: the path is walked twice at most."""
    whole = [glob_regex(r) for r in rules if "/" in r]
    parts = [glob_regex(r) for r in rules if "/" not in r]
    hit = F.lit(False)
    if whole:  # the whole path, or a parent of it: the match ends at a slash
        hit = hit | path.rlike(r"(?s)\A(?:" + "|".join(whole) + r")(?:/.*)?\z")
    if parts:
        hit = hit | path.rlike(r"(?s)(?:\A|/)(?:" + "|".join(parts) + r")(?:/|\z)")
    return hit


def matcher(rules: list[str]) -> Callable[[str], bool]:
    """What ``ignored`` says of a column, for one path, where folders are listed."""
    whole, parts = ("|".join(glob_regex(r) for r in rules if ("/" in r) == anchored) for anchored in (True, False))
    above = re.compile(f"(?:{whole})(?:/.*)?" if whole else r"(?!)", re.DOTALL)
    name = re.compile(f"(?:{parts})" if parts else r"(?!)", re.DOTALL)
    return lambda path: above.fullmatch(path) is not None or any(name.fullmatch(x) for x in path.split("/"))


def relative(path: Column, root: str) -> Column:
    """Path below root with forward slashes; null if nothing is left."""
    plain = F.regexp_replace(path, r"\\", "/")
    rest = F.regexp_replace(plain, "^" + re.escape(root.rstrip("/")) + "/?", "")
    return F.nullif(rest, F.lit(""))


def is_safe(path: Column) -> Column:
    """False for paths that would leave the root: absolute ones, drives and parent steps."""
    return ~(path.rlike(r"\A(?:/|\\|[A-Za-z]:)") | path.rlike(r"(?:\A|[/\\])\.\.(?:[/\\]|\z)"))


def short_id(ident: Column) -> Column:
    return F.lpad(F.lower(F.hex(ident.bitwiseAND(F.lit(4294967295)))), 8, "0")


def conflict_name(path: Column, peer: Column) -> Column:
    return F.concat(path, F.lit(".conflict-"), short_id(peer))
