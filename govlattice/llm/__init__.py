"""Operators for preparing training text: tokens, URL rules, main text, packing, quality, decontamination,
near-duplicates, chat pairs, language-model scores and repeated passages.

Nothing else in the library imports this package.
"""
