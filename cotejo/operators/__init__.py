"""Relational operators of the reconciliation engine: lazy DataFrame to DataFrame functions."""
