"""Training-data operators: search, archives, tokenizers, packing, joins, filters.

Nothing outside this subpackage imports it.
"""
