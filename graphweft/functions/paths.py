"""Paths: project-relative strings with / between names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """The folder of a path; the top folder is the empty path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column, top: bool = True) -> Column:
    """All folders above a path, outermost first; top: with the empty path."""
    names = parts(path)
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i - 1), "/"))
    return above if top else F.filter(above, lambda p: p != "")


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(parts(path)))


def normalised(path: Column) -> Column:
    """. and .. folded lexically; null if the path leaves its root."""

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        return F.when(held.isNull(), held).when(part.isin("", "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    folded = F.aggregate(parts(path), F.array().cast("array<string>"), step)
    return F.when(folded.isNotNull(), F.array_join(folded, "/"))


def joined(base: Column, target: Column) -> Column:
    """target as seen from the folder base; a leading / starts at the root, fragments and queries are cut; null if it leaves the root or has a scheme."""
    bare = F.regexp_replace(target, "[?#].*$", "")
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(base, F.lit("/"), bare))
    return F.when(~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (bare != ""), normalised(whole))
