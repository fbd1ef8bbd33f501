"""functions of the cluster-tree library."""
