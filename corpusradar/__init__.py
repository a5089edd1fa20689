"""corpusradar: research-corpus analytics as Spark DataFrame operators."""
