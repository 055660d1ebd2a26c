"""Operators of a large-scale training-data pipeline, over the tables `documents`,
`embeddings`, `pages`, `benchmark`, `labels` and `conversations`.

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` uses it.
"""
