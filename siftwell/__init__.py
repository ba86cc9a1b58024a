"""siftwell: relevance analytics over streams of content, as Spark DataFrame jobs."""
