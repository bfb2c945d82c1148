"""Ploidy of a sample at a position, and the allele number that follows from it.

The functions take SQL texts (names of columns, literals) and give SQL text: a plan needs many of them, and a text is one
call to the JVM where a tree of Columns is dozens.
"""

from __future__ import annotations

# Pseudo-autosomal regions, 1-based with both ends.
PAR = {
    "GRCh37": {"chrX": [(60001, 2699520), (154931044, 155260560)], "chrY": [(10001, 2649520), (59034050, 59363566)]},
    "GRCh38": {"chrX": [(10001, 2781479), (155701383, 156030895)], "chrY": [(10001, 2781479), (56887903, 57217415)]},
}


def is_par(chrom: str, pos: str, build: str) -> str:
    """True inside a pseudo-autosomal region of chrX or chrY; chromosomes must be canonical."""
    return "(" + " OR ".join(f"({chrom} = '{c}' AND {pos} BETWEEN {a} AND {b})" for c, regions in PAR[build].items() for a, b in regions) + ")"


def ploidy(chrom: str, pos: str, sex: str, build: str) -> str:
    """Copies of the position that a sample has: 1 on chrM, on chrY 1 for males and 0 else, on chrX outside PAR 1 for males, else 2."""
    return f"CASE WHEN {chrom} = 'chrM' THEN 1 WHEN {chrom} = 'chrY' THEN CASE WHEN {sex} = 'male' THEN 1 ELSE 0 END WHEN {chrom} = 'chrX' AND {sex} = 'male' AND NOT {is_par(chrom, pos, build)} THEN 1 ELSE 2 END"


def allele_number(chrom: str, pos: str, males: str, females: str, build: str) -> str:
    """AN of the given numbers of samples at a position."""
    male, female = (ploidy(chrom, pos, f"'{sex}'", build) for sex in ("male", "female"))
    return f"({males} * ({male}) + {females} * ({female}))"
