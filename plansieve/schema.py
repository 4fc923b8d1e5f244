"""Tables of the data model. Everything is long: one row a node, edge, or (plan, node)."""

from __future__ import annotations

NODES = "node_id long, pop double, votes_d double, votes_r double"
EDGES = "u long, v long, weight double, synthetic boolean"  # u < v, unique
ASSIGNMENT = "plan_id long, node_id long, district int"
SAMPLES = "chain_id int, sample_idx int, node_id long, district int"
CHAIN_STATS = "chain_id int, seed long, proposed long, rejected_pop long, rejected_contig long, accepted long"
METRICS = ("cut_edge_ratio", "mst_diameter", "modularity", "efficiency_gap", "mean_median")
GEOMETRIC = ("polsby_popper", "reock")
RINGS = "array<array<struct<x:double,y:double>>>"
