"""Writers: partitioned Parquet, dense arrays, index files, progress records."""
