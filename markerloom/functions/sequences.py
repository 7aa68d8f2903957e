"""Column expressions over DNA."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(sequence: Column) -> Column:
    """Upper case; whatever isn't a base becomes A."""
    return F.regexp_replace(F.upper(sequence), "[^CGT]", "A")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def kmer_signature(sequence: Column, k: int) -> Column:
    """The least canonical k-mer: equal for a sequence and its reverse complement; a shorter sequence is its own."""
    def canonical(i: Column) -> Column:
        word = F.substring(sequence, i, F.lit(k))
        return F.least(word, reverse_complement(word))

    return F.when(F.length(sequence) < k, sequence).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), F.length(sequence) - k + 1), canonical)))
