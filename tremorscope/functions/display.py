"""Texts that figures and tables show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import to_pp

# What a result says of its noise floor, of its axis, and of promotions within the band.
BELOW = "noise floor: below detection at this scale"
FLOOR = "noise floor ω = %s %%p"
INTRINSIC = "This run measures the intrinsic axis only (single paraphrase); a noise floor is not expected by design and becomes measurable only with the procedural axis (Exp 3)."
PROCEDURAL = "Procedural axis included: %.1f %s groups per cell enter the floor estimate."
STOPPING = "Seed %d: %d of %d accepted promotions sit inside the noise band"
AXES = {"paraphrase_id": "prompt-paraphrase"}


def three_digits(value: Column) -> Column:
    """A positive number to three significant digits, without trailing zeros; a 5 after them rounds up as it is written."""
    power = F.floor(F.log10(value)).cast("int")
    shown = F.round(value / F.pow(F.lit(10.0), power), 2) * F.pow(F.lit(10.0), power)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", F.round(shown, 8)), "0+$", ""), r"\.$", "")
    return F.when(value == 0, "0").otherwise(plain)


def noise_floor(omega_sq: Column, omega: Column, omega_sq_lo: Column, omega_hi: Column, scale: Column) -> Column:
    """A floor is told as a number only if its interval leaves zero out; else its upper end bounds it."""
    below = (omega_sq <= 0) | F.coalesce(omega_sq_lo <= 0, F.lit(False))
    bounded = F.concat(F.lit(BELOW), F.format_string(" (≤ %.2f %%p)", to_pp(omega_hi, scale)))
    return F.when(below & omega_hi.isNull(), BELOW).when(below, bounded).otherwise(F.format_string(FLOOR, three_digits(to_pp(omega, scale))))


def decay_caption(groups: Column, field: str) -> Column:
    """What axis a decay figure measures."""
    return F.when(groups <= 1, INTRINSIC).otherwise(F.format_string(PROCEDURAL, groups.cast("double"), F.lit(AXES.get(field, field))))


def stopping_title(seed: int, clears: Sequence[bool]) -> str:
    return STOPPING % (seed, sum(not c for c in clears), len(clears))


def sigma_reference(sigma_sq: Column) -> Column:
    """The sigma of a fitted slope."""
    return F.sqrt(F.greatest(sigma_sq, F.lit(0.0)))
