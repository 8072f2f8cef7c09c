"""Operators that turn index tables into scored rows ``(doc_id, score)``."""
