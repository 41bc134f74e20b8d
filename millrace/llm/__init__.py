"""Training-data operators for web-scale text corpora.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
