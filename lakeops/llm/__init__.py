"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it.  Each module holds one operator;
:mod:`lakeops.llm.queries` registers one query per operator.
"""
