"""Operators for training-data pipelines: licences, token counts, decontamination, quality,
deduplication, HTML and WARC handling, packing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
