"""Operators for preparing training text; nothing else in folio imports this subpackage."""
