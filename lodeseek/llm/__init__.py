"""Operations of a training-data pipeline: near-duplicates, tokenizers, language, privacy, packing, exact search.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
