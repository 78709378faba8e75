"""quern: retrieval, linking, profiling and graph operators over enterprise exports, written as Spark DataFrame transforms."""
