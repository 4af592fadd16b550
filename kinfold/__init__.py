"""kinfold: record resolution, auditing and change processing on Spark."""
