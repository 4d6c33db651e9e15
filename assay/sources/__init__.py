"""Readers and writers: fact tables, evaluation results, audit tables, partitions."""
