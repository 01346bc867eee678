"""Document retrieval, record conformance and evaluation as DataFrame operators on Spark."""
