"""Operations of a training-data pipeline; see each module's docstring.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py`` refers to it.
"""
