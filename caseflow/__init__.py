"""Case-table analytics for alarm root-cause analysis, as Spark DataFrame jobs."""
