"""Query plans: scoring, report assembly, and the registered queries."""
