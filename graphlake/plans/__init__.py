"""Registered queries by subject."""


def all_queries():
    """(queries, sql): every query of the library but the llm subpackage's."""
    from graphlake.plans import aggregates, base, documents, evaluation, graph, questions, retrieval, texts  # noqa: F401

    return dict(base.QUERIES), dict(base.SQL)
