"""Column functions on written values: folding, blanks, e-mail, phone, dates. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "no value".
FILLER_WORDS = [
    "", "-", "--", "?", ".", "n/a", "na", "n.a.", "nil", "none", "no", "null", "nan", "unknown", "not given", "not known",
    "not available", "not provided", "not applicable", "missing", "undefined", "unspecified", "blank", "empty", "tbd", "tba", "xxx", "xx", "x",
]
# Local parts and domains of mailboxes that belong to nobody.
NOBODY_LOCAL = ["test", "nobody", "none", "na", "n.a", "no", "null", "unknown", "noemail", "no-email", "nomail", "noreply", "no-reply", "donotreply", "anonymous", "blank", "missing", "xxx"]
NOBODY_DOMAIN = ["invalid.example", "none.example", "invalid", "none", "nowhere.example", "example.invalid"]
# Dates and digits that systems fill in by default.
DEFAULT_DATES = ["1900-01-01", "1901-01-01", "1970-01-01", "0001-01-01", "1111-11-11", "9999-12-31", "9999-09-09", "2099-12-31"]
DEFAULT_DIGITS = ["1234567890", "0123456789", "9876543210"]
# Letters with marks and what they are without.
MARKED = "àáâãäåāăąçćĉčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżžð"


def _pairs() -> tuple[str, str]:
    import unicodedata

    special = {"đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ø": "o", "ŧ": "t", "ð": "d"}
    return MARKED, "".join(special.get(c) or unicodedata.normalize("NFD", c)[0] for c in MARKED)


_FROM, _TO = _pairs()


def unmark_text(c: Column) -> Column:
    """Lower case, with precomposed letters without their accents."""
    s = F.translate(F.lower(c), _FROM, _TO)
    return F.replace(F.replace(F.replace(s, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def words_norm(s: Column) -> Column:
    """Letters and digits of ``unmark_text`` with one space between words; combining marks vanish."""
    bare = F.when(s.rlike(r"[^\x00-\x7f]"), F.regexp_replace(s, r"\p{M}+", "")).otherwise(s)
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def unmark(c: Column) -> Column:
    """Lower case without accents; composed and decomposed writing give the same."""
    return F.regexp_replace(unmark_text(c), r"\p{M}+", "")


def strip_accents(c: Column) -> Column:
    """Text without accents; letters that no accent is part of, such as ø and ł, stay."""
    keep = [(a, b) for a, b in zip(_FROM, _TO) if a not in "đħıłøŧð"]
    s = F.translate(c, "".join(a for a, _ in keep), "".join(b for _, b in keep))
    return F.regexp_replace(s, r"\p{M}+", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " "))


def present(c: Column) -> Column:
    """The value, or null if it is one kind of blank or another."""
    s = squeeze(c)
    return F.when(F.lower(s).isin(FILLER_WORDS), None).otherwise(s)


# Values of which an expression needs several reads are made in two steps, ``*_text`` and then ``*_norm``
# over that column: the steps stay apart as two projections, so nothing is worked out twice.
def email_text(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\p{Z}\s]+", ""))


def email_norm(s: Column) -> Column:
    """A mailbox (``email_text``); null for blanks and nobody's mailbox."""
    local, domain = F.split_part(s, F.lit("@"), F.lit(1)), F.split_part(s, F.lit("@"), F.lit(2))
    return F.when(s.isin(FILLER_WORDS) | ~s.contains("@") | local.isin(NOBODY_LOCAL) | domain.isin(NOBODY_DOMAIN), None).otherwise(s)


def phone_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^0-9]+", ""), r"^1(?=\d{10}$)", "")


def phone_norm(d: Column) -> Column:
    """National digits of a phone number (``phone_text``); null for blanks, too short values and default numbers."""
    return F.when((F.length(d) < 7) | d.rlike(r"^(\d)\1*$") | d.isin(DEFAULT_DIGITS), None).otherwise(d)


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


_DATE = {
    "iso": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
    "us": (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", (3, 1, 2)),
    "dotted": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)),
    "day first": (r"^(\d{1,2})(?:st|nd|rd|th)?[ .-]+([a-z]{3})[a-z]*\.?,?[ -]+(\d{4})$", (3, 2, 1)),
    "month first": (r"^([a-z]{3})[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", (3, 1, 2)),
    "digits": (r"^((?:19|20)\d\d)(\d\d)(\d\d)$", (1, 2, 3)),
}
_MONTH_NO = {m: f"{i:02d}" for i, m in enumerate(_MONTHS, 1)}


def date_text(c: Column) -> Column:
    """yyyy-mm-dd, still with default dates, of a date written year first, month/day/year, day.month.year
    or with the month's name; null for what can't be read."""
    out = None
    for p, (pattern, (yi, mi, di)) in _DATE.items():
        parts = [F.regexp_extract(c, pattern, i) for i in (yi, mi, di)]
        parts = [parts[0], *(F.lpad(x, 2, "0") for x in parts[1:])]
        if "month" in p or "day" in p:
            parts[1] = F.coalesce(*(F.when(F.regexp_extract(c, pattern, mi) == k, v) for k, v in _MONTH_NO.items()))
        out = F.when(c.rlike(pattern), F.concat_ws("-", *parts)) if out is None else out.when(c.rlike(pattern), F.concat_ws("-", *parts))
    return out


def date_norm(s: Column) -> Column:
    """A date (``date_text``) unless it is one that systems fill in."""
    return F.when(s.isin(DEFAULT_DATES), None).otherwise(s)
