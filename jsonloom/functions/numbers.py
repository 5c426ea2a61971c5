"""Numbers without loss: canonical spellings for equality, and the shortest text of a double."""

from __future__ import annotations

import math

import numpy as np

_CHUNK = 4000  # digits that int() and str() are sure to take
_BIG = 10**_CHUNK


def _integer(digits: str) -> int:
    if len(digits) <= _CHUNK:
        return int(digits)
    out = 0
    for i in range(0, len(digits), _CHUNK):
        part = digits[i : i + _CHUNK]
        out = out * 10 ** len(part) + int(part)
    return out


def _digits(n: int) -> str:
    out = []
    while n >= _BIG:
        n, low = divmod(n, _BIG)
        out.append(str(low).zfill(_CHUNK))
    return str(n) + "".join(reversed(out))


def canonical(spelling: str) -> str:
    """One spelling for all spellings of a number, at any magnitude: sign, digits without zeros at the ends, exponent.

    Digits are never expanded: 1e400 is 1e400, 0.00 and -0 are 0, 1.50 and 15e-1 are 15e-1."""
    sign, body = ("-", spelling[1:]) if spelling[0] == "-" else ("", spelling)
    mantissa, _, exponent = body.replace("E", "e").partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    if not digits:
        return "0"
    kept = digits.rstrip("0")
    shift = len(digits) - len(kept) - len(fraction)
    if exponent:
        negative = exponent[0] == "-"
        size = _integer(exponent.lstrip("+-"))
        shift += -size if negative else size
    return f"{sign}{kept}e{'-' if shift < 0 else ''}{_digits(abs(shift))}"


def float_text(value: float, bits: int = 64) -> str:
    """Shortest text that reads back as the same value: no `.0`, an exponent below 1e-6 and from 1e21 on, -0 kept.

    NaN and the infinities have none: ValueError."""
    if math.isnan(value) or math.isinf(value):
        name = "NaN" if math.isnan(value) else "+Inf" if value > 0 else "-Inf"
        raise ValueError(f"unsupported float value {name}")
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    shortest = np.format_float_scientific(np.float32(value) if bits == 32 else np.float64(value), trim="-")
    mantissa, _, exponent = shortest.partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    digits, point = mantissa.replace(".", ""), int(exponent)
    if -6 <= point < 21:
        if point < 0:
            return f"{sign}0.{'0' * (-point - 1)}{digits}"
        if len(digits) <= point + 1:
            return sign + digits + "0" * (point + 1 - len(digits))
        return f"{sign}{digits[: point + 1]}.{digits[point + 1 :]}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if point < 0 else '+'}{abs(point)}"
