"""Training-data operators: dedup, near-dedup, PII, LM scoring, WARC, mixing,
HTML extraction, decontamination, quality filtering and line dedup.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and their SQL.
"""
