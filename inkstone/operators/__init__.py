"""Operators from a DataFrame of documents to relations, scores, selections and facts.

A document is a row with an id and a text. Ids name documents: they are unique
and not null. Texts may be null or empty; such documents have no sentences.
"""
