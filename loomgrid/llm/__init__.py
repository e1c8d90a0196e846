"""Operators for preparing training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; it can be removed without
touching the rest of the library.
"""
