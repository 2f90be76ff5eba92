"""Column builders: allele tokens, statistics, text helpers."""
