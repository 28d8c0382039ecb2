"""claimloom: collecting, aligning and reconciling quantitative claims with Spark.

Everything is a lazy DataFrame transformation.  ``functions`` holds column
expressions, ``operators`` holds DataFrame-to-DataFrame operators, ``sources``
reads and writes tables, ``streaming`` is the incremental front door and
``plans`` is the catalogue of ready-made queries with their SQL oracles.
"""

__version__ = "0.1.0"
