"""Historical-analog retrieval and decision stress testing over panel time series, on Spark."""
