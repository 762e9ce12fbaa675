"""Training-data operators: quality, dedup, media, language, mixing, extraction, packing, PII, licences.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only if it can be imported.
"""
