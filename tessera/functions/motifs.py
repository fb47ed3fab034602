"""Scalar functions: motif names, trimming, bins, rounding and packed keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of cutting enzymes and the motif that each cuts at.
ENZYMES = {
    "TCGA": "TaqI Taq1",
    "GGCC": "HaeIII Hae3",
    "GATC": "DpnI Dpn1 DpnII Dpn2 MboI Mbo1 Sau3AI",
    "AGCT": "AluI Alu1",
    "CATG": "NlaIII Nla3 FaeI Fae1 FatI Fat1 Hin1II Hsp92II",
    "CCGG": "HpaII Hpa2",
    "GGATG": "FokI Fok1",
    "CGGCG": "AaaI Aaa1",
    "GACGC": "HgaI Hga1",
    "AGATCT": "BglII Bgl2",
    "GATATC": "EcoRV EcoR5",
    "GAATTC": "EcoRI EcoR1",
    "GGATCC": "BamHI BamH1",
    "AAGCTT": "HindIII Hind3",
    "GGTACC": "KpnI Kpn1",
    "TCTAGA": "XbaI Xba1",
    "CTCGAG": "XhoI Xho1",
    "GAGCTC": "SacI Sac1",
    "CTGCAG": "PstI Pst1",
    "CCCGGG": "SmaI Sma1",
    "CAGCTG": "PvuII Pvu2",
    "GTCGAC": "SalI Sal1",
    "AGTACT": "ScaI Sca1",
    "ACTAGT": "SpeI Spe1",
    "GCATGC": "SphI Sph1",
    "AGGCCT": "StuI Stu1",
    "CATATG": "NdeI Nde1",
    "GCGGCCGC": "NotI Not1",
}
_MOTIF_OF = {name.upper(): motif for motif, names in ENZYMES.items() for name in names.split()}


def resolve_motif(name: str) -> str:
    """The motif of an enzyme's name, or the name itself, upper-cased, if it is one of A, C, G and T."""
    upper = name.upper()
    if upper in _MOTIF_OF:
        return _MOTIF_OF[upper]
    if not re.fullmatch("[ACGT]+", upper):
        raise ValueError(f"neither an enzyme nor a motif: {name!r}")
    return upper


def trimmed_right(text: Column) -> Column:
    """Without white space (space, tab, line feed, vertical tab, form feed, return) at the end."""
    return F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+$", "")


def floor_bin(pos: Column, size: int | Column) -> Column:
    return pos - pos % size


def truncated5(value: Column) -> Column:
    """Cut, not rounded, to five decimals."""
    return (value * 100000.0).cast("bigint") / F.lit(100000.0)


def squared(value: Column) -> Column:
    return value * value


def packed_key(a: Column, b: Column) -> Column:
    """Two 32-bit integers in one of 64 bits, the first in its upper half."""
    return F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpacked_key(key: Column) -> tuple[Column, Column]:
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(key, 32).cast("int"), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def first_position(motif: str, sequence: Column) -> Column:
    """The first position of a motif, from 0, or -1."""
    return F.locate(motif, sequence) - 1
