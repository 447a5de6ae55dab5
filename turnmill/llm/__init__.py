"""Operators on training text; nothing outside this subpackage imports it."""

QUERY_MODULES = [
    "turnmill.llm.p1_queries",
    "turnmill.llm.p2_queries",
    "turnmill.llm.p4_queries",
    "turnmill.llm.p5_queries",
    "turnmill.llm.p67_queries",
    "turnmill.llm.p8_queries",
]
