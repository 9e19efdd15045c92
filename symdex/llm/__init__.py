"""Training-data operators: quality, language, duplicates, contamination, secrets, tokens, chat, pages.

Nothing outside this subpackage imports it.
"""
