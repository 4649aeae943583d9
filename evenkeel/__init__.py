"""evenkeel: incremental keyed aggregation with fixed-shape outputs, on PySpark."""
