"""Training-data operators: quality, mixing, similarity joins, secrets, toxicity,
decontamination, token counts, language-model scores, chat formats and web archives.

Nothing else in ``fieldloom`` imports this subpackage.
"""
