"""Operators for preparing language-model training text at scale.

Nothing else in the library imports this subpackage; ``registry`` lists the
queries and SQL that ``__spark_entry__`` adds when the subpackage is present.
"""
