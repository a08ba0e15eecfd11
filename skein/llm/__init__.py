"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; the thin
``opN_*`` queries and their SQL live in ``queries.py``. Nothing outside this
package (and ``corpus_pipeline.py`` at the repository top) imports it.
"""
