"""Queries that apply the operators to whole tables."""


def load() -> None:
    """Imports the modules that register queries."""
    from lattisca.plans import analysis_queries, feature_queries, graph_queries, label_queries, representation_queries, source_queries, structure_queries  # noqa: F401
