"""tabloom: profile, clean, annotate, featurise and relate any table with Spark.

Every stage is a DataFrame-to-DataFrame function.  A stage may run one small
*decision* action (a facts table with one row per column) and then returns a
lazy projection built from those facts.
"""

__version__ = "0.1.0"
