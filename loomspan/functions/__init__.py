"""Column functions on sequences, qualities, identifiers and scores. All but ``two_digits`` are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The standard genetic code in the usual order of bases, and what tables 4 and 12 change in it.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {1: {}, 4: {"TGA": "W"}, 12: {"CTG": "S"}}
# IUPAC codes of base sets.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N"}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def codon_table(table: int = 1) -> dict[str, str]:
    """Codon to amino acid in table 1, 4 or 12; stops are '*'."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, CODE)) | CHANGES[table]


def degeneracy(table: int = 1) -> dict[str, int]:
    """How many codons share a codon's first two bases and its amino acid, for coding codons: 4 marks a free third base."""
    code = codon_table(table)
    return {c: sum(code[c[:2] + b] == code[c] for b in BASES) for c in code if code[c] != "*"}


def gc(seq: Column | str) -> Column:
    """Share of G and C; null for an empty sequence."""
    s = _col(seq)
    return F.try_divide(F.regexp_count(s, F.lit("[GCgc]")).cast("double"), F.length(s))


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"))


def subseq(seq: Column | str, start: Column | str, stop: Column | str) -> Column:
    """Residues start to stop (1-based); the reverse complement of stop to start if start is greater."""
    s, a, b = _col(seq), _col(start).cast("int"), _col(stop).cast("int")
    return F.when(a <= b, F.substr(s, a, b - a + 1)).otherwise(revcomp(F.substr(s, b, a - b + 1)))


def codons(seq: Column | str) -> Column:
    """Array of whole codons in frame 0."""
    return F.coalesce(F.regexp_extract_all(F.upper(_col(seq)), F.lit("(?s).{3}"), F.lit(0)), F.array().cast("array<string>"))


def translate_cds(seq: Column | str, table: int = 1) -> Column:
    """Peptide of the whole codons; codons with other letters are X."""
    code = _map(codon_table(table))
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def check_translation(pep: Column | str, given: Column | str) -> Column:
    """What comparing a translation with the one supplied shows: ok, internal_stop or differs; a final stop is ignored."""
    p, g = (F.regexp_replace(_col(x), r"\*$", "") for x in (pep, given))
    return F.when(p.contains("*"), "internal_stop").when(p == g, "ok").otherwise("differs")


def iupac(alleles: Column) -> Column:
    """Ambiguity code of an array of bases; null where none fits."""
    return F.try_element_at(_map(IUPAC), F.array_join(F.array_sort(F.array_distinct(alleles)), ""))


def iupac_expand(code: Column | str) -> Column:
    """Array of the bases that a code stands for."""
    bases = F.try_element_at(_map({v: k for k, v in IUPAC.items()}), F.upper(_col(code)))
    return F.filter(F.split(bases, ""), lambda b: b != "")


def phred(qual: Column | str, offset: int = 33) -> Column:
    """Array of integer qualities of a quality string."""
    return F.transform(F.filter(F.split(_col(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def to_sanger(qual: Column | str) -> Column:
    """Quality string of offset 64 as one of offset 33."""
    return F.array_join(F.transform(phred(qual, 64), lambda q: F.chr(q + 33)), "")


def strip_isoform(name: Column | str) -> Column:
    """Identifier without an isoform, transcript or version suffix (T0, -RA, .1, _t1)."""
    return F.regexp_replace(_col(name), r"(T\d+|-[RP][A-Z]|\.\d+|_[tT]\d+)$", "")


def split_gene(name: Column | str) -> Column:
    """Struct (species, gene) of ``species|gene`` or ``species_gene``, split at the first separator."""
    parts = F.split(_col(name), r"[|_]", 2)
    return F.struct(parts[0].alias("species"), F.try_element_at(parts, F.lit(2)).alias("gene"))


def gff_escape(text: Column | str) -> Column:
    """Attribute value with %, tab, line breaks and separators as %XX."""
    out = F.replace(_col(text), F.lit("%"), F.lit("%25"))
    for c in "\t\n\r&=;,":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def rename(name: Column | str, rules: dict[str, str], default: Column | None = None) -> Column:
    """Name by the first pattern that matches it whole; its replacement may use $1."""
    n, out = _col(name), default if default is not None else _col(name)
    for pattern, to in reversed(rules.items()):
        out = F.when(n.rlike(f"^(?:{pattern})$"), F.regexp_replace(n, f"^(?:{pattern})$", to)).otherwise(out)
    return out


def scaled_evalue(bits: Column | str, qlen: Column | str, dbsize: float) -> Column:
    """Expected hits of a score in a database of ``dbsize`` residues."""
    return F.lit(dbsize) * _col(qlen) / F.pow(F.lit(2.0), _col(bits))


@F.pandas_udf(StringType())
def _two_digits(value: pd.Series) -> pd.Series:
    return value.map(lambda x: f"{x:.1e}", na_action="ignore")


def two_digits(value: Column | str) -> Column:
    """A number with two significant digits as text; 0 is 0e0. The number's exact value decides, and in the middle the
    even digit, as in C and Perl; Spark's own format rounds the shortest text of the number and always up (1.25e8: 1.3e+08)."""
    v = _col(value)
    return F.when(v == 0, "0e0").otherwise(_two_digits(v.cast("double")))


def codon_change(cds: Column | str, pos: Column | str, allele: Column | str) -> Column:
    """Struct (index, old, new, old_aa, new_aa) of replacing base ``pos`` (1-based) of a coding sequence."""
    s, p = _col(cds), _col(pos).cast("int")
    index = F.floor((p - 1) / 3).cast("int")
    old = F.substr(s, index * 3 + 1, F.lit(3))
    new = F.overlay(old, _col(allele), p - index * 3, F.lit(1))
    return F.struct((index + 1).alias("index"), old.alias("old"), new.alias("new"), translate_cds(old).alias("old_aa"), translate_cds(new).alias("new_aa"))


def feature_name(attrs: Column | str, order: tuple[str, ...] = ("Name", "Parent", "ID", "Note")) -> Column:
    """First attribute of ``order`` that there is."""
    return F.coalesce(*(F.try_element_at(_col(attrs), F.lit(k)) for k in order))


def fmt(value: Column | str, spec: str) -> Column:
    return F.format_string(spec, _col(value))
