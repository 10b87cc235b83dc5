"""Topic scans, sinks and views over the test tables."""
