"""Scalar parsing and naming rules, as SQL expressions."""

from __future__ import annotations

# Amount suffixes; the first is the unit, the second a ten-thousandth of it.
HUNDRED_MILLION = "亿"
TEN_THOUSAND = "万"


def parse_amount(c: str) -> str:
    """``"1.5亿"`` -> 1.5, ``"300万"`` -> 0.03, plain numbers unchanged, anything else 0."""
    text = f"trim(CAST({c} AS STRING))"
    number = f"try_cast(regexp_replace({text}, '[{HUNDRED_MILLION}{TEN_THOUSAND}]', '') AS DOUBLE)"
    return (
        f"coalesce(CASE WHEN contains({text}, '{TEN_THOUSAND}') AND NOT contains({text}, '{HUNDRED_MILLION}') "
        f"THEN {number} / 10000 ELSE {number} END, 0D)"
    )


def normalize_code(c: str) -> str:
    """Strip a trailing ``.0`` and pad with zeros to six characters; longer codes stay whole."""
    text = f"regexp_replace(trim(CAST({c} AS STRING)), '[.]0$', '')"
    return f"CASE WHEN length({text}) >= 6 THEN {text} ELSE lpad({text}, 6, '0') END"


def strip_market_prefix(c: str) -> str:
    """``sh600000`` or ``0.600000`` -> ``600000``: the six or more digits at the end, else the text itself."""
    return f"coalesce(nullif(regexp_extract({c}, '([0-9]{{6,}})$', 1), ''), {c})"


# Fixed value: the first character of a purchase.
BUY = "买"


def normalize_direction(c: str) -> str:
    """``buy`` for a text that begins with the sign of a purchase, otherwise ``sell``."""
    return f"CASE WHEN startswith(CAST({c} AS STRING), '{BUY}') THEN 'buy' ELSE 'sell' END"


def limit_pct(code: str = "code") -> str:
    """Daily price limit: 20% for the 30 and 68 prefixes, otherwise 10%."""
    return f"CASE WHEN substring({code}, 1, 2) IN ('30', '68') THEN 0.2D ELSE 0.1D END"


def change(a: str, b: str) -> str:
    """Relative change from ``b`` to ``a``."""
    return f"(({a} - {b}) / {b})"
