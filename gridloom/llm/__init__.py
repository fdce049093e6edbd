"""Training-data operators: formatting, PII, language ID, sharding, deduplication, decontamination, packing, token counts.

Nothing else in the library imports this subpackage.
"""
