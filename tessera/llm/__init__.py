"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``tessera.llm.queries`` holds the
thin contract queries and ``corpus_pipeline.py`` chains five of the operators.
"""
