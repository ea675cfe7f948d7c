"""Training-data operators: chat formatting, sharding, packing, token counts, near-duplicates,
secret scans, quality scores and rules, benchmark decontamination and line de-duplication.

Nothing outside this subpackage imports it.
"""
