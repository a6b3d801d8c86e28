"""Nucleotide alphabet: ambiguity codes, complements and 4-bit base masks."""

from __future__ import annotations

# The IUPAC nucleotide codes and the bases each one stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

BASES = "ACGT"
MASK = {code: sum(1 << BASES.index(b) for b in bases) for code, bases in IUPAC.items()}
_CODE_OF_MASK = {m: c for c, m in MASK.items()}


def complement_code(code: str) -> str:
    """The ambiguity code whose bases pair with those of ``code`` (A-T, C-G)."""
    return _CODE_OF_MASK[sum(1 << (3 - BASES.index(b)) for b in IUPAC[code])]


CODES = "".join(IUPAC)
COMPLEMENT_FROM = CODES + "U"
COMPLEMENT_TO = "".join(complement_code(c) for c in CODES) + "A"

# One printable character per mask (64 + mask), so that masks travel as plain strings.
PRIMER_MASK_TO = "".join(chr(64 + MASK[c]) for c in CODES)
# On a template N is unknown and matches nothing, so its mask is zero.
TEMPLATE_MASK_TO = PRIMER_MASK_TO.replace(chr(64 + MASK["N"]), chr(64))
