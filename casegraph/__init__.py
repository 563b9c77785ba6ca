"""casegraph: link analysis and case analytics as Spark DataFrame functions."""
