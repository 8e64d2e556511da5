"""codeloom: code-corpus analytics expressed as Spark DataFrame queries.

Every public function takes DataFrames and returns a DataFrame.  All tables
carry ``run_id``; all joins, groups and windows are keyed by it first, so one
job serves one repository or millions of them.
"""
