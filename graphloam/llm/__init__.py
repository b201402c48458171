"""Operators on the texts of a corpus.  Nothing else in the package imports this."""
