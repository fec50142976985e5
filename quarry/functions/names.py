"""Name, key and path expressions.  All are built-in Catalyst expressions, so
they stay inside whole-stage codegen and can be pushed or folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# Slug length limit and the alphabet kept by the slug rule.
SLUG_MAX_LEN = 128
SLUG_INVALID = "[^a-z0-9-]"


def safe_name(c) -> Column:
    """Lower-case slug: invalid characters to '-', runs collapsed, dashes
    trimmed, empty to null, cut at 128 characters and trimmed again."""
    c = as_col(c)
    s = F.regexp_replace(F.regexp_replace(F.lower(c), SLUG_INVALID, "-"), "-+", "-")
    s = _trim_dashes(s)
    s = F.when(F.length(s) > SLUG_MAX_LEN, _trim_dashes(F.substring(s, 1, SLUG_MAX_LEN))).otherwise(s)
    return F.nullif(s, F.lit(""))


def _trim_dashes(c: Column) -> Column:
    return F.btrim(c, F.lit("-"))


def scoped_name(workspace, domain, folder: str, default: str, generic: str) -> Column:
    """Replace the generic default name by slug(workspace-folder), else
    slug(domain-folder), else keep it.  ``concat`` is null-propagating, which
    is what makes a missing workspace fall through to the domain."""
    ws = present(as_col(workspace))
    dm = present(as_col(domain))
    suffix = "-" + (folder or "documents")
    derived = F.coalesce(safe_name(F.concat(ws, F.lit(suffix))),
                         safe_name(F.concat(dm, F.lit(suffix))))
    d = F.lit(default)
    return F.when(d == F.lit(generic), F.coalesce(derived, d)).otherwise(d)


def present(c) -> Column:
    """Missing is falsy: null, empty string and the literal text 'null'."""
    c = as_col(c)
    return F.nullif(F.nullif(c, F.lit("")), F.lit("null"))


def document_key(c) -> Column:
    """Unpadded URL-safe base64 of the UTF-8 path.  ``base64`` may wrap lines,
    so line breaks are removed before translating the alphabet."""
    c = as_col(c)
    b = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")
    return F.rtrim(F.translate(b, "+/", "-_"), F.lit("="))


def decode_key(c) -> Column:
    """Inverse of :func:`document_key` (re-pads and decodes)."""
    c = as_col(c)
    std = F.translate(c, "-_", "+/")
    pad = F.repeat(F.lit("="), (F.lit(4) - F.length(std) % 4) % 4)
    return F.decode(F.unbase64(F.concat(std, pad)), "UTF-8")


def path_leaf(c, default: str | None = None) -> Column:
    """Last '/' segment; ``default`` when the path is missing or ends empty."""
    c = as_col(c)
    leaf = F.nullif(F.element_at(F.split(c, "/"), -1), F.lit(""))
    return F.coalesce(leaf, F.lit(default)) if default is not None else leaf


def url_leaf(c) -> Column:
    """Leaf of a URL with the query and fragment removed."""
    return path_leaf(F.regexp_replace(as_col(c), r"[?#].*$", ""))


def path_segment(c, i: int) -> Column:
    """Zero-based i-th '/' segment, null when out of range."""
    return F.get(F.split(as_col(c), "/"), i)


def compose_id(fmt: str, *parts) -> Column:
    """Hierarchical id from parts, only when every part is present."""
    cols = [present(as_col(p)) for p in parts]
    ok = None
    for p in cols:
        ok = p.isNotNull() if ok is None else (ok & p.isNotNull())
    return F.when(ok, F.format_string(fmt, *cols))


# Document folder categories.
CATEGORIES_LAKEHOUSE = ["contracts", "reports", "policies", "manuals"]
CATEGORY_PATTERN = r"Files/documents/([^/]+)/"


def category_of(c, allowed: list[str] | None = None) -> Column:
    """Folder category below ``Files/documents/``; null when not in ``allowed``
    (compared case-insensitively)."""
    cat = F.nullif(F.regexp_extract(as_col(c), CATEGORY_PATTERN, 1), F.lit(""))
    if allowed is None:
        return cat
    return F.when(F.lower(cat).isin([a.lower() for a in allowed]), cat)


def split_names(c) -> Column:
    """Comma list → array of trimmed, non-blank names (explode for rows)."""
    arr = F.transform(F.split(as_col(c), ","), lambda x: F.trim(x))
    return F.filter(arr, lambda x: x != F.lit(""))


def excerpt(c, n: int = 100) -> Column:
    """First n characters plus '...' when longer; the text itself otherwise."""
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def utf8_size(c) -> Column:
    """Byte length of the UTF-8 encoding, as bigint."""
    return F.octet_length(as_col(c)).cast("bigint")
