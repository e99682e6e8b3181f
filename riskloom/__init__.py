"""riskloom: text-risk analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   column expressions (redaction, lexicon risk, text, rates, web)
operators   DataFrame -> DataFrame jobs by subject area
sources     readers, exports and append-only tables
streaming   Structured Streaming jobs
plans       multi-step jobs and the query catalog
"""

__version__ = "0.1.0"
