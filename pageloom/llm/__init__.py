"""Operators for preparing training corpora. Nothing else in pageloom imports this subpackage."""
