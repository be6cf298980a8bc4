"""Training-data operators: quality, URLs, language, contamination, licences,
tokens, repeats, near copies, toxicity and shards.

Nothing outside this subpackage imports it.
"""
