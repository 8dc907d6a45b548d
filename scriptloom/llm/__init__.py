"""Training-data operators: scans, near-dedup, mixing, filters, packing, search, extraction.

Nothing outside this subpackage (besides the guarded import of the driver entry and
``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
