"""Operators on reads, base observations, alleles, intervals and call sets."""
