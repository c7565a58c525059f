"""Training-data operators: WARC scans, tokenizers, deduplication, decontamination and text filters.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames to a DataFrame;
work on texts runs in Arrow batches, vectorised with numpy where a text has to be looked at byte by byte.
"""
