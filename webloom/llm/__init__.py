"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every operator takes DataFrames and
keeps only the columns it names, so extra columns of any name do no harm.
"""
