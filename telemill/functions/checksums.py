"""Checksum validators as SQL fragments over a string of digits."""

from __future__ import annotations

from collections.abc import Sequence

from telemill.functions.sqltext import let, lit, when

# Published weights of the Australian identifier checksums.
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
IHI_PREFIX = "800360"

BLANK = r"\s"


def digits_only(text: str) -> str:
    """ASCII digits of the text."""
    return f"regexp_replace({text}, '[^0-9]', '')"


def count_digits(text: str) -> str:
    """Number of ASCII digits in the text."""
    return f"length({digits_only(text)})"


def digit_at(digits: str, position: int) -> str:
    """The digit at a 1-based position as an integer."""
    return f"(ascii(substring({digits}, {position}, 1)) - 48)"


def weighted_sum(digits: str, weights: Sequence[int]) -> str:
    """Sum of digit times weight, from the first digit on."""
    return "(" + " + ".join(f"{digit_at(digits, i)} * {w}" for i, w in enumerate(weights, start=1)) + ")"


def all_digits(digits: str, length: str) -> str:
    """Only ASCII digits, as many as the repetition says."""
    return f"coalesce({digits} RLIKE '^[0-9]{{{length}}}$', false)"


def luhn(digits: str) -> str:
    """Luhn check of a non-empty string of ASCII digits."""
    return f"({all_digits(digits, '1,')} AND coalesce(luhn_check({digits}), false))"


def valid_tfn(digits: str) -> str:
    """Tax file number; eight digits count as nine with a leading zero."""
    padded = let("tfn", f"lpad({digits}, 9, '0')", f"{weighted_sum('tfn', TFN_WEIGHTS)} % 11 = 0")
    return f"({all_digits(digits, '8,9')} AND {padded})"


def valid_abn(digits: str) -> str:
    """Australian business number: one is taken off the first digit before weighting."""
    return f"({all_digits(digits, '11')} AND ({weighted_sum(digits, ABN_WEIGHTS)} - {ABN_WEIGHTS[0]}) % 89 = 0)"


def valid_acn(digits: str) -> str:
    """Australian company number: the ninth digit complements the weighted sum."""
    return f"({all_digits(digits, '9')} AND ({weighted_sum(digits, ACN_WEIGHTS)} + {digit_at(digits, 9)}) % 10 = 0)"


def valid_medicare(digits: str) -> str:
    """Medicare card number with check digit nine and a non-zero issue number."""
    return (
        f"(coalesce({digits} RLIKE '^[2-6][0-9]{{8}}[1-9]$', false)"
        f" AND {weighted_sum(digits, MEDICARE_WEIGHTS)} % 10 = {digit_at(digits, 9)})"
    )


def valid_ihi(digits: str) -> str:
    """Individual healthcare identifier: fixed prefix, sixteen digits, Luhn."""
    return f"({all_digits(digits, '16')} AND startswith({digits}, {lit(IHI_PREFIX)}) AND {luhn(digits)})"


def iban_valid(text: str) -> str:
    """ISO 13616 mod-97 check of an IBAN, blanks ignored."""
    step = "IF(ascii(ch) < 58, (total * 10 + ascii(ch) - 48) % 97, (total * 100 + ascii(ch) - 55) % 97)"
    turned = "concat(substring(iban, 5), substring(iban, 1, 4))"
    remainder = f"aggregate(split({turned}, '(?!^)(?!$)'), 0, (total, ch) -> {step})"
    return let(
        "iban",
        f"upper(regexp_replace({text}, {lit(BLANK)}, ''))",
        when([("iban RLIKE '^[0-9A-Z]{15,34}$'", f"{remainder} = 1")], "false"),
    )


def card_network(digits: str) -> str:
    """Payment network by prefix and length; null when none fits."""
    size, two, four = f"length({digits})", f"substring({digits}, 1, 2)", f"substring({digits}, 1, 4)"
    return when(
        [
            (f"startswith({digits}, '4') AND {size} IN (13, 16, 19)", "'Visa'"),
            (f"{size} = 16 AND ({two} BETWEEN '51' AND '55' OR {four} BETWEEN '2221' AND '2720')", "'Mastercard'"),
            (f"{size} = 16 AND ({four} = '6011' OR {two} = '65')", "'Discover'"),
            (f"{size} = 16 AND {two} = '35'", "'JCB'"),
            (f"{size} = 15 AND {two} IN ('34', '37')", "'Amex'"),
            (f"{size} IN (14, 16) AND ({two} IN ('36', '38') OR startswith({digits}, '300'))", "'Diners'"),
        ]
    )


def valid_card(digits: str) -> str:
    """13 to 19 digits that pass Luhn and belong to a known network."""
    return f"({all_digits(digits, '13,19')} AND {luhn(digits)} AND {card_network(digits)} IS NOT NULL)"
