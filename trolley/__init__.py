"""Shopping-basket and order analytics as plain PySpark DataFrame functions.

``sources``    schemas, CSV/Parquet readers, writers, sample-table mapping
``functions``  small helpers: broadcast size check, shared scratch folder, caching
``operators``  building blocks: line totals, cleaning, skew-safe windows, itemsets
``plans``      the finished reports, as DataFrame functions and as SQL text
"""
