"""Column expressions. All are built from ``pyspark.sql.functions`` and run in the JVM."""
