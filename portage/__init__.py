"""Table and file transfers as Spark jobs.

Sub-packages: ``functions`` (Column expressions), ``sources`` (scans and listings), ``operators`` (sinks, copies, run
log, registry), ``plans`` (transfer specs and runs) and ``streaming`` (incremental ingest).
"""
