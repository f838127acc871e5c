"""Readers: FASTA, substring tables, vocabularies, weights."""
