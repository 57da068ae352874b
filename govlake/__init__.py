"""govlake: analytics over large partitioned Parquet collections, on PySpark."""
