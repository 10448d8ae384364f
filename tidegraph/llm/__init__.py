"""Training-data operators: each module holds one operator, ``queries`` the registered ones.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
