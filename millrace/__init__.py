"""Spark analytics workloads and the cost of checkpointing them, as DataFrame operators."""
