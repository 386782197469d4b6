"""Spark-first engine for recovering structured, validated content from semi-structured documents."""
