"""tiller: retail analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; no operator runs an
action except where noted: FP-growth fitting, its basket count and its itemsets
(``operators.rules``) and the calendar's ends of ``cohorts.retention_matrix``
without given indices.  Sub-packages:

* ``sources``   - readers for the pipe-separated inputs, the star-schema
                  stand-ins used by tests and benchmarks, and sinks;
* ``functions`` - column-level helpers (typed projection, missing-value
                  predicates, shares, fixed labels);
* ``operators`` - profiling, catalogue, basket, temporal, customer, cohort,
                  association-rule and forecast operators;
* ``plans``     - the named query register, its SQL twins and the report job.
"""

__version__ = "0.1.0"
