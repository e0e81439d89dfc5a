"""Operators for building training corpora: deduplication, search, extraction,
language and quality scoring, pseudonyms, packing, fixity audit and mixing."""
