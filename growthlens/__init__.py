"""growthlens: company growth and investment signals as Spark jobs.

Sources (``sources``), column functions (``functions``), operators
(``operators``), registered plans and their SQL oracles (``plans``) and
Structured Streaming jobs (``streaming``).  See README.md.
"""

__version__ = "0.1.0"
