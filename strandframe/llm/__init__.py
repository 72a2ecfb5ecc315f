"""Operators for preparing training text: de-duplication, filters, extraction, formatting and mixing."""
