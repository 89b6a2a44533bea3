"""Host-graph analytics for network-flow logs, written as Spark DataFrame jobs."""
