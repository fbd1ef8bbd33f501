"""plans of the cluster-tree library."""
