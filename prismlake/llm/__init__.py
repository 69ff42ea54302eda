"""Operators for preparing training text at scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Each
module holds one operator with a general interface; ``queries`` derives the
registered ``opN_<name>`` results from them.
"""
