"""All registered queries of the engine and their oracles."""

from __future__ import annotations

from turnwise.plans import q_frames, q_graph, q_text

QUERIES = {**q_text.QUERIES, **q_frames.QUERIES, **q_graph.QUERIES}
ORACLE = {**q_text.ORACLE, **q_frames.ORACLE, **q_graph.ORACLE}
