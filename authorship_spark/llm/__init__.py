"""Operations that prepare text corpora for training: one module per operator.

``registry`` holds the registered queries and their SQL. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
