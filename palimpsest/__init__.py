"""palimpsest: bitemporal document analytics on Apache Spark.

Every dated state of every document is a row; operators are DataFrame-to-DataFrame
functions that Catalyst plans.  ``operators`` holds the building blocks, ``plans`` the
public read operations made of them, ``sources`` readers and writers, ``functions``
column expressions and ``streaming`` the incremental forms.
"""
