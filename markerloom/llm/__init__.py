"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface;
:mod:`markerloom.llm.queries` binds them to the tables of the data folder.
"""
