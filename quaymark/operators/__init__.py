"""Relational operators of the recognition pipeline: rows in, rows out, every tie broken by an ordinal."""
