"""Path expressions for POSIX paths, Windows paths and object-store URIs.

Every function takes the path as SQL text: a column name or an expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The part of a path in front of its first component.
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://|/+|\\\\)?"


def _windows(p: str) -> str:
    """Drive-letter (C:\\) and share (\\\\server) paths; everything else separates with /."""
    return rf"(not startswith({p}, '/') and substring({p}, 2, 1) = ':' or startswith({p}, r'\\'))"


def _separator(p: str) -> str:
    return rf"if({_windows(p)}, r'\', '/')"


def _base(p: str) -> str:
    return f"substring_index({p}, {_separator(p)}, -1)"


def _components(p: str) -> str:
    rest = f"regexp_replace({p}, r'{_PREFIX}', '')"
    return rf"filter(split({rest}, if({_windows(p)}, r'\\', '/')), part -> part <> '')"


def plain_folder(path: str) -> Column:
    """A folder's path without repeated separators and without one at its end, but for roots.

    The double separator in front of shares and behind a URI's scheme stays.
    """
    p, backslash = F.expr(path), F.lit("\\")
    scheme = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9+.-]*://", 0)
    single = F.regexp_replace(F.substring(p, F.char_length(scheme) + 1, F.char_length(p)), "/+", "/")
    posix = F.concat(scheme, F.when((single == "/") & (scheme == ""), single).otherwise(F.regexp_replace(single, "/$", "")))
    share = F.when(F.startswith(p, F.lit("\\\\")), backslash).otherwise("")
    joined = F.regexp_replace(p, r"\\+", r"\\")
    bare = F.when(F.rlike(joined, F.lit(r"^.:\\$")), joined).otherwise(F.regexp_replace(joined, r"\\$", ""))
    return F.when(F.expr(_windows(path)), F.concat(share, bare)).otherwise(posix)


def base_name(path: str) -> Column:
    """The last component."""
    return F.expr(_base(path))


def parent_of(path: str) -> Column:
    """The folder holding a path; a root is its own parent."""
    cut = f"left({path}, char_length({path}) - char_length({_base(path)}) - 1)"
    return F.expr(
        rf"case when {cut} = '' and startswith({path}, '/') then '/'"
        rf" when {_windows(path)} and {cut} rlike '^.:$' then {cut} || r'\'"
        rf" when {cut} rlike '^[A-Za-z][A-Za-z0-9+.-]*:/$' then {path}"
        rf" else {cut} end"
    )


def join_path(folder: str, name: str) -> Column:
    sep = _separator(folder)
    return F.expr(f"if(endswith({folder}, {sep}), {folder} || {name}, {folder} || {sep} || {name})")


def path_depth(path: str) -> Column:
    """How many non-empty parts a path has, whichever separator is used."""
    return F.expr(rf"size(filter(split({path}, r'[\\/]'), part -> part <> ''))")


def components(path: str) -> Column:
    """The folder and file names a path consists of, outermost first."""
    return F.expr(_components(path))


def tree_level(path: str) -> Column:
    """Position of a path in its tree: always one more than its parent's."""
    return F.expr(f"size({_components(path)})")


def level_of_root(root: str) -> int:
    """:func:`tree_level` of a scan root named by the caller."""
    return len([part for part in re.split(r"[\\/]", re.sub(_PREFIX, "", root)) if part])


def ancestors(path: str) -> Column:
    """Every folder on the way to a path, outermost first, the path itself last."""
    nul = r"'\u0000'"
    upto = f"replace(b.prefix || array_join(slice(b.parts, 1, i), {nul}), {nul}, b.sep)"
    drive = rf"if(i = 1 and {upto} rlike '^.:$', {upto} || r'\', {upto})"
    below = f"transform(sequence(1, size(b.parts)), i -> {drive})"
    root = "if(b.prefix = '/', array('/'), cast(array() as array<string>))"
    bound = (
        f"struct({_components(path)} as parts, regexp_extract({path}, r'{_PREFIX}', 0) as prefix, "
        f"{_separator(path)} as sep)"
    )
    # A one-element array binds the split path, so it is split once.
    every = f"if(size(b.parts) = 0, array({path}), concat({root}, {below}))"
    return F.expr(f"element_at(transform(array({bound}), b -> {every}), 1)")
