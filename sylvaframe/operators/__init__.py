"""operators of the cluster-tree library."""
