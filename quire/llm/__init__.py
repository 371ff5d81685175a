"""Training-data operators: search, decontamination, formatting, language id,
extraction, de-duplication, mixing, toxicity and language-model scoring.

Nothing outside this subpackage imports it.
"""
