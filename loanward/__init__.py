"""loanward: data-quality rules, lending analytics and table preparation on Spark.

Start with :func:`loanward.sources.tables.load_tables` for Parquet tables, pick a
rule pack from :mod:`loanward.plans.packs`, and evaluate it with
:func:`loanward.plans.evaluate.evaluate`.
"""
