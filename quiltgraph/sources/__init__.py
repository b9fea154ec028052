"""Graph formats, the commerce graph of the driver tables, and Parquet layouts."""
