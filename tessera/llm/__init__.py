"""Operators for building training corpora.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, keeps documents apart by an integer id column, and is written so
that a lost executor only costs a recomputation: no localCheckpoint, no files
outside the shared checkpoint folder, no state on the driver that grows with
the corpus.
"""
