"""Operators for training-data pipelines.

Nothing else in ``tarn`` imports this subpackage; it can be deleted whole.
Each ``opN_*`` module holds one operator with a general interface and a thin
``query`` function that applies it to a whole table under ``sf_dir``.
"""
