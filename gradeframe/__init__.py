"""gradeframe: evaluation tables for language-model output, as Spark jobs.

Questions, responses and scores are DataFrames; every step (load, dedupe,
task grid, prompt rendering, inference, parsing, lexical metrics, resume)
is a DataFrame operator that Catalyst plans and Spark distributes.
"""

__version__ = "0.1.0"
