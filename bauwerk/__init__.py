"""Set-wise extraction, repair, checking and export of bills of quantities on Spark."""
