"""pressloom: news-event analytics and corpus preparation on Spark."""
