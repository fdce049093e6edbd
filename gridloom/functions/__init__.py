"""Column expressions: masks, bits, dates, hashes, spectral indexes and harmonics."""
