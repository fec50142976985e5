"""Value semantics: presence, precedence, case folding, ages, outcomes, JSON
paths and redaction.  All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .names import present

# Placeholder shape rejected by the config readers.
PLACEHOLDER_PATTERN = r"^<.*>$"
# Bearer-token redaction rule (matched case-insensitively).
BEARER_PATTERN = r"(?i)Bearer [A-Za-z0-9\-._~+/]+=*"
BEARER_MARKER = "Bearer [REDACTED]"


def usable(c) -> Column:
    """Present and not a ``<placeholder>``."""
    p = present(as_col(c))
    return F.when(~p.rlike(PLACEHOLDER_PATTERN), p)


def first_present(*cols) -> Column:
    """First present, non-placeholder value by precedence."""
    return F.coalesce(*[usable(c) for c in cols])


def ci_equal(a, b) -> Column:
    """Case-insensitive equality (the scripts' default comparison)."""
    return F.lower(as_col(a)) == F.lower(as_col(b))


def age_days(created, now) -> Column:
    """Whole elapsed 24-hour periods between ``created`` and ``now``."""
    return F.timestamp_diff("DAY", as_col(created), as_col(now))


def old_enough(created, now, max_age_days: int) -> Column:
    """Unknown creation date counts as old enough."""
    return F.coalesce(age_days(created, now) >= F.lit(max_age_days), F.lit(True))


# Response bodies and outcome labels of the create loop.
BODY_UNSUPPORTED_SKU = "UnsupportedCapacitySKU"
BODY_NAME_IN_USE = "ItemDisplayNameAlreadyInUse"
BODY_NOT_ACTIVE = "NotInActiveState"


def classify_outcome(code, body) -> Column:
    """Ordered rule: 2xx created; unsupported SKU stop; name in use or 409
    present; not active retry; 5xx or 429 retry; anything else failed."""
    code = as_col(code)
    body = F.coalesce(as_col(body), F.lit(""))
    return (
        F.when((code >= 200) & (code < 300), F.lit("created"))
        .when(body.rlike("(?i)" + BODY_UNSUPPORTED_SKU), F.lit("unsupported"))
        .when(body.rlike("(?i)" + BODY_NAME_IN_USE) | (code == 409), F.lit("present"))
        .when(body.rlike("(?i)" + BODY_NOT_ACTIVE), F.lit("retry"))
        .when((code >= 500) | (code == 429), F.lit("retry"))
        .otherwise(F.lit("failed"))
    )


def json_path(c, path: str) -> Column:
    """Dotted traversal into a JSON string; null on a missing step or bad JSON."""
    return F.get_json_object(as_col(c), "$." + path)


def redact_tokens(c) -> Column:
    return F.regexp_replace(as_col(c), BEARER_PATTERN, BEARER_MARKER)


def ilike_any(c, pattern: str) -> Column:
    """Wildcard match like ``-like '*x*'`` (case-insensitive)."""
    return as_col(c).ilike(pattern.replace("*", "%"))
