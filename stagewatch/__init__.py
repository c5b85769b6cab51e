"""stagewatch: data-quality monitoring and repair for batch ETL runs on Spark.

Every question about a run (schema drift, null and duplicate profiles, key
checks, repairs, stage health, root cause, history trends) is a
DataFrame -> DataFrame operator over run tables keyed by ``run_id``, so one
Spark job answers it for all runs at once.
"""

__version__ = "0.1.0"
