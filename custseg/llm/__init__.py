"""Training-data operators: packing, scans, cleaning, deduplication, archives, search.

One module per operator; ``queries`` holds the thin registered queries. Nothing else in the
library imports this package.
"""
