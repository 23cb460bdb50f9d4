"""Training-data operators: quality, deduplication, decontamination, mixing and scans.

Nothing else in the library imports this subpackage.  ``registry`` lists the
queries that ``__spark_entry__.py`` adds when this subpackage is there.
"""
