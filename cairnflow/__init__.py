"""cairnflow: feature engineering on Spark, from raw events to training sets."""
