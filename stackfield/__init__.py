"""Frame stacking on Spark: captures as tables of frames and of pixels."""
