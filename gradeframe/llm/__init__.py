"""Training-data operators: one module per operator, plus their queries and SQL.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported, and ``corpus_pipeline.py`` chains five of
the operators.
"""
