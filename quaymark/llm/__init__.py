"""Training-data operators.

Each module holds one operator with a general interface; ``queries.py`` registers the thin queries
over the driver tables.  Nothing outside this folder imports it except the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
