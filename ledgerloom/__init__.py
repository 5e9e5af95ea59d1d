"""Spark-native analytics over mailbox-like records and the tables found inside documents."""
