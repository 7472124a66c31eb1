"""siftline: a Spark-first engine for document-like records from many feeds."""
