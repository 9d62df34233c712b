"""Training-data operators over text, page and vector tables.

Nothing outside this folder imports it; the package works without it.
"""
