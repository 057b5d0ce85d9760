"""Spark-native experiment analytics: trial logs in, verdicts, audits and rankings out."""
