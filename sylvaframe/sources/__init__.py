"""sources of the cluster-tree library."""
