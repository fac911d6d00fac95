"""Training-data operators over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this folder imports it, except ``corpus_pipeline.py`` and the guarded
registration in ``__spark_entry__.py``.
"""
