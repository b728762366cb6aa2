"""DataFrame operators over edges(u, v), nodes(id) and assign(node, cluster)."""
