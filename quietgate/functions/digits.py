"""Decimal digits of every script, and the two checksummed identifiers built on them."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# First code points of decimal-digit runs added in Unicode 14-16,
# which an older JVM's \p{Nd} may not know yet.
RECENT_ZEROS = [
    0x10D40, 0x116D0, 0x116DA, 0x11BF0, 0x11F50, 0x16D70, 0x1CCF0, 0x1E4F0, 0x1E5F1,
]


def _zeros() -> list[int]:
    known = {
        c for c in range(sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) == 0
    }
    return sorted(known | set(RECENT_ZEROS))


_ZEROS = _zeros()
_FROM = "".join(chr(z + d) for z in _ZEROS for d in range(10))
_TO = "0123456789" * len(_ZEROS)

# Candidate patterns see digits through \p{Nd}; digits the JVM may not know are shown to them as
# full-width digits, one code point for one, so offsets stay put.
DIGIT = r"\p{Nd}"
_RECENT = "".join(chr(z + d) for z in RECENT_ZEROS for d in range(10))
_STAND_IN = "".join(chr(0xFF10 + d) for d in range(10)) * len(RECENT_ZEROS)
_RECENT_RANGE = rf"[\x{{{min(RECENT_ZEROS):x}}}-\x{{{max(RECENT_ZEROS) + 9:x}}}]"


def known_digits(text: Column) -> Column:
    """Text with recently encoded digits replaced by full-width ones; almost always unchanged."""
    return F.when(
        text.rlike(_RECENT_RANGE), F.translate(text, _RECENT, _STAND_IN)
    ).otherwise(text)


def ascii_digits(candidate: Column) -> Column:
    """Map each decimal digit to 0-9. Apply to a matched candidate, never to a document."""
    return F.translate(candidate, _FROM, _TO)


def luhn_ok(digits: Column) -> Column:
    """Mod-10 check over 13-19 ASCII digits that are not all the same."""

    def total(rev: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(rev), F.lit(1))),
            F.lit(0),
            lambda acc, i: acc
            + F.when(i % 2 == 1, F.substr(rev, i, F.lit(1)))
            # doubled digit with its own digits summed: 0 2 4 6 8 1 3 5 7 9
            .otherwise(F.translate(F.substr(rev, i, F.lit(1)), "0123456789", "0246813579"))
            .cast("int"),
        )

    return (
        F.length(digits).between(13, 19)
        & ~digits.rlike(r"^(.)\1*$")
        & (let(F.reverse(digits), total) % 10 == 0)
    )


def rrn_ok(value: Column) -> Column:
    """Resident number: 13 digits whose first six are a real date in the century of digit 7."""

    def check(d: Column) -> Column:
        gender = F.substr(d, F.lit(7), F.lit(1))
        century = (
            F.when(gender.isin("1", "2", "5", "6"), "19")
            .when(gender.isin("3", "4", "7", "8"), "20")
            .otherwise("18")
        )
        born = F.concat(century, F.substr(d, F.lit(1), F.lit(6)))
        return (F.length(d) == 13) & F.try_to_date(born, "yyyyMMdd").isNotNull()

    return let(F.regexp_replace(ascii_digits(value), "[^0-9]", ""), check)
