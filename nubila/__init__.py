"""Nubila: neighbourhood analytics over batched point clouds, written as Spark DataFrame plans."""
