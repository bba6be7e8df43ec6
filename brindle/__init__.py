"""brindle: a relational analytics engine that lowers to Spark DataFrames.

``brindle.engine.Engine`` runs the SQL dialect (queries, DML, DDL, transactions)
over versioned Parquet tables; ``brindle.operators`` offers the same operators as
functions over DataFrames; ``brindle.dbapi`` is a DB-API 2.0 facade.
"""
