"""Training-data operators: quality, licences, language, near copies, shards, packs, mixes, secrets, archives, vectors,
infilling, resampling, tokens.

Nothing outside this subpackage imports it. ``catalog`` lists the registered queries and their SQL.
"""
