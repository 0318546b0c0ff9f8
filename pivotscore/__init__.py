"""pivotscore: round-trip translation fidelity analytics on Spark.

Packages: ``sources`` (tables, cache, result files), ``functions`` (text
primitives, backends, p-values), ``operators`` (scoring, statistics,
relations, report tables, quality, edit rates), ``plans`` (cached
translation and the three protocols), ``checks`` (DuckDB oracle SQL).
``registry`` names every query.
"""
