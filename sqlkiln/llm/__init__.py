"""Operators for preparing training corpora, one module per operator.

Nothing outside this package imports it; ``queries.py`` registers the
``opN_*`` queries and ``corpus_pipeline.py`` chains five of them.
"""
