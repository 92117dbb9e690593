"""ravelin: Spark-native processing of retrieval and question-answering data."""
