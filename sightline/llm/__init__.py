"""Training-data pipeline operators over the ``documents``-style tables.

One module per operator. Nothing else in ``sightline`` imports this
subpackage; it only borrows general helpers (scratch paths) from it.
"""
