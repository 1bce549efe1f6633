"""Column rules for identifiers, dates, classes and claim texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values the results depend on.
DECISION_DATE = dt.date(2014, 6, 19)
TREATED_STATUS_CODES = [161, 163, 61]
PATENTED_STATUS_CODE = 150
ISSUED_NUMBER_PATTERN = r"^\d{1,3}\.{0,1}\s"
PREGRANT_NUMBER_PATTERN = r"^\d{1,3}\s{0,}\.{0,1}\s"
CLAIM_REFERENCE_PATTERN = r"\bclaims?\s+\d+\b"
WHITE_SPACE = " \t\n\x0b\f\r"
CANCELLED_WORD = "canceled"
CANCELLED_MAX_LETTERS = 20


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int_id(c: ColumnOrName) -> Column:
    """Numeric identifier; text such as ``D123`` or ``nan`` becomes null."""
    c = _col(c).cast("string")
    as_double = c.try_cast("double")
    return F.coalesce(c.try_cast("bigint"), F.when(~F.isnan(as_double), as_double.try_cast("bigint")))


def to_date(c: ColumnOrName) -> Column:
    return _col(c).try_cast("date")


def norm_class(c: ColumnOrName, missing: str | None = None) -> Column:
    """Text before the first dot without leading zeros; ``missing`` replaces nulls."""
    text = _col(c).cast("string")
    if missing is not None:
        text = F.coalesce(text, F.lit(missing))
    return F.ltrim(F.substring_index(text, ".", 1), F.lit("0"))


def clean_publication_number(c: ColumnOrName) -> Column:
    """``US20130123456A1`` -> ``20130123456``."""
    return F.regexp_replace(F.regexp_replace(_col(c).cast("string"), "^US", ""), r"[a-zA-Z]{1,1}\d{0,1}$", "")


def strip_space(c: ColumnOrName) -> Column:
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def strip_claim_number(c: ColumnOrName, origin: str, trim: bool = True) -> Column:
    """Drop the leading claim number; ``origin`` is ``issued`` or ``pregrant``."""
    pattern = {"issued": ISSUED_NUMBER_PATTERN, "pregrant": PREGRANT_NUMBER_PATTERN}[origin]
    text = F.regexp_replace(_col(c), pattern, "")
    return strip_space(text) if trim else text


def is_independent(dependent: ColumnOrName, origin: str) -> Column:
    dependent = _col(dependent)
    if origin == "pregrant":
        return dependent.isNull()
    # -1 arrives as a number or as text such as "-1.0"
    return dependent.isNull() | F.coalesce(to_int_id(F.trim(dependent)) == -1, F.lit(False))


def refers_to_claim(text: ColumnOrName) -> Column:
    # The plain search spares most texts the pattern.
    return _col(text).contains("claim") & _col(text).rlike(CLAIM_REFERENCE_PATTERN)


def is_cancelled(text: ColumnOrName) -> Column:
    letters = F.regexp_replace(_col(text), "[^A-Za-z]", "")
    return letters.contains(CANCELLED_WORD) & (F.length(letters) < CANCELLED_MAX_LETTERS)


def flag_is_not_one(c: ColumnOrName) -> Column:
    """True for null and for every value but 1."""
    return ~_col(c).eqNullSafe(F.lit(1))


def pure_ground() -> Column:
    """Rejection rests on subject matter alone."""
    flags = ["rejection_fp_mismatch", "rejection_102", "rejection_103", "rejection_112", "rejection_dp"]
    cond = flag_is_not_one(flags[0])
    for flag in flags[1:]:
        cond = cond & flag_is_not_one(flag)
    return cond


def in_claim_list(claim: ColumnOrName, claim_numbers: ColumnOrName) -> Column:
    """The list is compared as written, its items are not trimmed."""
    return F.array_contains(F.split(_col(claim_numbers), ","), _col(claim).cast("string"))


def right_publication(pgpub_number: ColumnOrName, earliest: ColumnOrName) -> Column:
    number = norm_class(pgpub_number)
    return (number == clean_publication_number(earliest)) | (number == "")


def logical_dates(mail: ColumnOrName, filing: ColumnOrName, status: ColumnOrName, publication: ColumnOrName) -> Column:
    mail, filing, status, publication = map(to_date, (mail, filing, status, publication))
    return (mail > filing) & (status > mail) & (publication > filing)


def within_dates(c: ColumnOrName, start: dt.date, stop: dt.date) -> Column:
    return (_col(c) >= F.lit(start)) & (_col(c) < F.lit(stop))


def quarter_end(c: ColumnOrName) -> Column:
    """Next quarter end strictly after the date."""
    return F.last_day(F.add_months(F.trunc(F.date_add(_col(c), 1), "quarter"), 2))


def post_flag(quarter: ColumnOrName, decision: dt.date = DECISION_DATE) -> Column:
    return (_col(quarter) > F.lit(decision)).cast("int")


def unique_claim_id(app_id: ColumnOrName, claim: ColumnOrName) -> Column:
    return F.concat_ws("_", _col(app_id).cast("string"), _col(claim).cast("string"))


def uniform_from_key(key: ColumnOrName) -> Column:
    """Reproducible u in (0, 1) from an integer key, equal in every SQL engine.

    The key is reduced to 31 bits first, so the product stays below 2^63 for
    any key; keys that differ by a multiple of 2^31 share their u.
    """
    spread = (F.pmod(_col(key).cast("bigint"), F.lit(2147483648)) * F.lit(2654435761)) % F.lit(4294967296)
    return (spread + F.lit(0.5)) / F.lit(4294967296.0)


def uniform_from_hash(seed: int, *keys: ColumnOrName) -> Column:
    """Reproducible u in (0, 1) from any key columns."""
    hashed = F.xxhash64(F.lit(seed), *[_col(k) for k in keys])
    return (F.shiftrightunsigned(hashed, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
