"""Part of the document-corpus engine."""
