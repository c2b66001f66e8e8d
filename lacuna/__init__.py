"""Gap analytics on Spark: find, score and reconstruct missing samples of long series."""
