"""platewise — a Spark-native warehouse for an ordering-and-delivery marketplace.

Layers: raw CSV sources → stage (provenance) → clean (typed projections) →
consumption (calendar + SCD2 dimensions, facts) → views and KPI sets.
Every step is a DataFrame plan; nothing row-level runs in Python.
"""

__version__ = "0.1.0"
