"""Alphabets: symbols, degenerate letters, gaps, complements."""

from __future__ import annotations

from dataclasses import dataclass, field

GAPS = "-._"


@dataclass(frozen=True)
class Alphabet:
    """symbols in code order; degenerate letters with the symbols that they stand for; complement of each letter."""

    name: str
    symbols: str
    degenerate: dict = field(default_factory=dict)
    complement: dict = field(default_factory=dict)
    gaps: str = GAPS

    @property
    def letters(self) -> str:
        return self.symbols + "".join(self.degenerate)

    def expand(self, letter: str) -> str:
        """The symbols that a letter stands for; a gap or an unknown letter stands for none."""
        letter = letter.upper()
        return letter if letter in self.symbols else self.degenerate.get(letter, "")

    def code(self, letter: str) -> int:
        """0.. for symbols, the first expansion's code for degenerate letters, -2 for gaps, -1 for anything else."""
        found = self.expand(letter)
        return self.symbols.index(found[0]) if found else -2 if letter in self.gaps else -1

    def table(self):
        """Codes of all 128 ASCII characters; lower case counts as upper case."""
        import numpy as np

        return np.array([self.code(chr(c)) for c in range(128)], dtype=np.int8)

    def is_valid(self, letter: str) -> bool:
        return bool(self.expand(letter)) or letter in self.gaps

    def matches(self, a: str, b: str) -> bool:
        """Whether two letters can stand for the same symbol; gaps match gaps."""
        if a in self.gaps or b in self.gaps:
            return a in self.gaps and b in self.gaps
        return bool(set(self.expand(a)) & set(self.expand(b)))


#: IUPAC nucleotide codes and their complements.
IUPAC_CODES = {
    "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
COMPLEMENTS = dict(zip("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN", strict=True))

DNA = Alphabet("DNA", "ACGT", {}, {c: COMPLEMENTS[c] for c in "ACGT"})
NUCLEOTIDE = Alphabet("IUPAC nucleotide", "ACGT", IUPAC_CODES, COMPLEMENTS)
#: One-letter amino acids in alphabetical order, and the ambiguous ones.
AMINO = Alphabet("IUPAC amino", "ACDEFGHIKLMNPQRSTVWY", {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTVWY", "U": "C", "O": "K"})

REGISTRY = {"DNA": DNA, "nucleotide": NUCLEOTIDE, "amino": AMINO}


def alphabet(name: str) -> Alphabet:
    if name not in REGISTRY:
        raise ValueError(f"unknown alphabet {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
