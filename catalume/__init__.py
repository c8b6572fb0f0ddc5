"""Asset catalog jobs on Spark: functions over DataFrames, nothing held outside them."""
