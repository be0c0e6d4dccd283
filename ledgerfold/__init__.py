"""ledgerfold — reconciling registry extracts with a fixed form, on Spark."""
