"""Training-data operators and the queries that apply them.

Nothing outside this folder imports it, apart from the guarded registration
in ``__spark_entry__`` and ``corpus_pipeline``.
"""
