"""All catalogue queries (importing the modules registers them)."""

from gradewise.plans import q_blanks, q_code, q_grading, q_io, q_scoring, q_similarity  # noqa: F401
from gradewise.plans.registry import ORACLE, QUERIES  # noqa: F401
