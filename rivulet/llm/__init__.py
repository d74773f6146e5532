"""Training-data operators: filtering, near-duplicates, scoring and mixing.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and ``oracle.py`` their SQL.
"""
