"""Relational operators: documents, profiles, pairs, aligned kernels, metrics, scores, reports."""
