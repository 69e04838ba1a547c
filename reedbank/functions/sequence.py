"""Sequence functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reedbank.functions.alphabet import COMPLEMENTS, GAPS, IUPAC_CODES, NUCLEOTIDE

GAP_CLASS = "[-._]"


def reverse_complement(seq: Column) -> Column:
    pairs = COMPLEMENTS | {a.lower(): b.lower() for a, b in COMPLEMENTS.items()}
    return F.translate(F.reverse(seq), "".join(pairs), "".join(pairs.values()))


def complement(seq: Column) -> Column:
    return F.reverse(reverse_complement(seq))


def encode(seq: Column) -> Column:
    """Codes as digits: 0 to 3 for bases and for the first base of a degenerate letter, '-' for gaps, '?' for all else."""
    letters = NUCLEOTIDE.letters
    up = F.regexp_replace(F.upper(seq), f"[^{letters}{'.'}_-]", "?")
    return F.translate(up, letters + "._", "".join(str(NUCLEOTIDE.code(c)) for c in letters) + "--")


def decode(codes: Column) -> Column:
    return F.translate(codes, "0123", NUCLEOTIDE.symbols)


def ungap(seq: Column) -> Column:
    return F.regexp_replace(seq, GAP_CLASS, "")


def gap_count(seq: Column) -> Column:
    return F.length(seq) - F.length(ungap(seq))


def symbol_count(seq: Column, symbols: str = "ACGT") -> Column:
    return F.length(seq) - F.length(F.translate(seq, symbols, ""))


def is_valid(seq: Column, letters: str = NUCLEOTIDE.letters, gaps: str = GAPS) -> Column:
    return F.upper(seq).rlike(f"^[{letters}{gaps.replace('-', '')}-]*$")


def degenerate_match(a: Column, b: Column) -> Column:
    """Whether two letters can stand for the same base: the sets of bases of each meet."""
    sets = {s: s for s in "ACGT"} | IUPAC_CODES
    spell = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in sets.items() for x in kv]), F.upper(c))
    both_gaps = a.rlike(f"^{GAP_CLASS}$") & b.rlike(f"^{GAP_CLASS}$")
    return F.coalesce(both_gaps | F.arrays_overlap(F.split(spell(a), ""), F.split(spell(b), "")), F.lit(False))


def subsequence(seq: Column, start, length) -> Column:
    """From 0-based start, length characters; a length of -1 goes to the end."""
    return F.substring(seq, F.lit(start) + 1, F.length(seq) if isinstance(length, int) and length < 0 else F.lit(length))


def quality_at(qual: Column, position, default: int = 30, shift: int = 33) -> Column:
    """Phred score at a 0-based position; default without a quality string."""
    return F.when(qual.isNull() | (qual == ""), F.lit(default)).otherwise(F.ascii(F.substring(qual, F.lit(position) + 1, F.lit(1))) - shift)


def wrap(seq: Column, width: int = 60) -> Column:
    return seq if width <= 0 else F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def alignment_description(description: Column, start: Column, end: Column) -> Column:
    """A read's description with the columns that its alignment covers behind it."""
    return F.concat(F.coalesce(description, F.lit("")), F.lit(";csStart="), start.cast("string"), F.lit(";csEnd="), end.cast("string"), F.lit(";"))


def fasta(id_: Column, description: Column, seq: Column, width: int = 60) -> Column:
    head = F.concat(F.lit(">"), id_, F.when(description.isNull() | (description == ""), F.lit("")).otherwise(F.concat(F.lit(" "), description)))
    return F.concat(head, F.lit("\n"), wrap(seq, width))


def fastq(id_: Column, description: Column, seq: Column, qual: Column, default: int = 30, shift: int = 33) -> Column:
    head = F.concat(F.lit("@"), id_, F.when(description.isNull() | (description == ""), F.lit("")).otherwise(F.concat(F.lit(" "), description)))
    plain = F.when(qual.isNull() | (qual == ""), F.repeat(F.lit(chr(default + shift)), F.length(seq))).otherwise(qual)
    return F.concat(head, F.lit("\n"), seq, F.lit("\n+\n"), plain)


def pad(insert: Column, width: Column, mode: str, fill: str = "-") -> Column:
    """Fit insert into width columns: left-aligned, right-aligned, in the middle, or justified (halves at both sides)."""
    short = F.substring(insert, F.lit(1), width)
    room = width - F.length(short)
    filled = lambda n: F.repeat(F.lit(fill), n.cast("int"))
    if mode == "left":
        return F.concat(short, filled(room))
    if mode == "right":
        return F.concat(filled(room), F.substring(insert, F.greatest(F.length(insert) - width, F.lit(0)) + 1, width))
    if mode == "middle":
        half = F.floor(room / 2)
        return F.concat(filled(half), short, filled(room - half))
    if mode == "justified":
        half = F.floor((F.length(short) + 1) / 2).cast("int")
        return F.concat(F.substring(short, F.lit(1), half), filled(room), F.substring(short, half + 1, F.length(short)))
    raise ValueError(f"unknown padding {mode!r}")


def alignment_identity(aligned: Column, start: Column, end: Column) -> Column:
    """Upper-case bases in columns start..end (1-based, closed) over the number of columns."""
    window = F.substring(aligned, start, end - start + 1)
    return symbol_count(window, NUCLEOTIDE.letters) / (end - start + 1)


def profile_identity(aligned: Column, columns: Column, start: Column, end: Column) -> Column:
    """The same over the profile's columns (an array of 1-based columns) in the stretch; null without one."""
    inside = F.filter(columns, lambda c: (c >= start) & (c <= end))
    hits = F.filter(inside, lambda c: F.substring(aligned, c, F.lit(1)).rlike(f"^[{NUCLEOTIDE.letters}]$"))
    return F.try_divide(F.size(hits).cast("double"), F.size(inside))
