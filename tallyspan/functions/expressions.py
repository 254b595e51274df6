"""Column expressions of the domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CHROMOSOMES, FACTOR_COLOURS, FALLBACK_COLOUR


def kept_chromosome(chrom: Column) -> Column:
    return chrom.isin(*CHROMOSOMES)


def short_chromosome(chrom: Column) -> Column:
    """chr1 -> 1."""
    return F.regexp_replace(chrom, "chr", "")


def strand(raw: Column) -> Column:
    """+, 0 -> +; -, 1 -> -; anything else is unstranded."""
    return F.when(raw.isin("+", "0"), "+").when(raw.isin("-", "1"), "-").otherwise(".")


def first_match(name: Column, cases, otherwise: Column) -> Column:
    """The value of the first (substring, value) that ``name`` contains."""
    chain = reduce(lambda c, case: c.when(name.contains(case[0]), case[1]), cases[1:], F.when(name.contains(cases[0][0]), cases[0][1]))
    return chain.otherwise(otherwise)


def factor_colour(name: Column, strict: bool = False) -> Column:
    """Colour of a factor by name; unknown names get the fallback, or null if ``strict``."""
    return first_match(F.upper(name), FACTOR_COLOURS, F.lit(None).cast("string") if strict else F.lit(FALLBACK_COLOUR))


def line_style(name: Column) -> Column:
    return F.when(name.contains("CM") | name.contains("ATAC"), "-").otherwise("--")


def cell_label(name: Column) -> Column:
    return first_match(name, (("100K", "100K"), ("10M", "10M"), ("500K", "500K")), F.lit(None).cast("string"))


def sample_name(*parts: Column) -> Column:
    """Parts joined by underscores, missing ones as ``nan``."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def name_part(name: Column, index: int) -> Column:
    """Part of a sample name, from 0; negative counts from the end."""
    return F.element_at(F.split(name, "_"), index + 1 if index >= 0 else index)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def technique_name(technique: Column, ip: Column, names: dict[str, str]) -> Column:
    """Display name of a technique code by ``names``; any other is ATAC-seq, or ChIP-tagmentation if it has a factor."""
    named = reduce(lambda c, kv: c.when(technique == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return named.when(ip.isNull() | (ip == "nan"), "ATAC-seq").otherwise("ChIP-tagmentation")


def rgb(hex_colour: Column) -> Column:
    """#rrggbb -> r,g,b."""
    return F.concat_ws(",", *[F.conv(F.substring(hex_colour, 2 + 2 * k, 2), 16, 10) for k in range(3)])


def kernel(name: str, width: int) -> list[float]:
    """Smoothing weights, scaled to sum 1; a width under 3 has one weight, which changes nothing."""
    from math import cos, pi

    turn = [2 * pi * t / (width - 1) for t in range(width)] if width > 1 else [0.0]
    forms = {
        "flat": lambda t: 1.0,
        "hanning": lambda t: 0.5 - 0.5 * cos(turn[t]),
        "hamming": lambda t: 0.54 - 0.46 * cos(turn[t]),
        "bartlett": lambda t: 1.0 - abs(2.0 * t / (width - 1) - 1.0),
        "blackman": lambda t: 0.42 - 0.5 * cos(turn[t]) + 0.08 * cos(2 * turn[t]),
    }
    if name not in forms:
        raise ValueError(f"unknown kernel {name!r}: one of {', '.join(forms)}")
    if width < 3:
        return [1.0]
    weights = [forms[name](t) for t in range(width)]
    return [w / sum(weights) for w in weights]


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double, without the decimal that it makes of each value, except next to a tie or beyond 10^9 units of the last digit."""
    scaled = F.abs(value) * float(10**digits)
    down = F.floor(scaled)
    k = down + F.when(scaled - down > 0.5, 1).otherwise(0)
    quick = F.when(value < 0, -k).otherwise(k) / F.lit(float(10**digits))
    return F.when((scaled < 1e9) & (F.abs(scaled - down - 0.5) > 1e-6), quick).otherwise(F.round(value, digits))
