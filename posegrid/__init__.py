"""posegrid: depth-frame and skeletal-motion analytics as Spark DataFrame programs."""
