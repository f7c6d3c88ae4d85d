"""Mixture deconvolution and relational analytics as Spark jobs."""
