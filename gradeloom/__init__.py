"""gradeloom: data work around text classification, written as Spark jobs.

Every operator takes and returns DataFrames or Columns and uses the session of
its input.  ``functions`` holds column expressions, ``operators`` the joins,
reports, samples and models, ``sources`` the readers and writers and ``plans``
the complete flows.
"""
