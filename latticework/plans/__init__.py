"""What a report is, when it runs and in which order: pure Python, no Spark job."""
