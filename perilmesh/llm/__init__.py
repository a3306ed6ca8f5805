"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Its queries are in
``perilmesh.llm.queries`` and the five-stage corpus pipeline is in
``corpus_pipeline.py`` at the repository top.
"""
