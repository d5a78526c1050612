"""skein: graph analytics and property-graph queries as Spark DataFrame programs.

The public names are loaded when they are first used, so Python workers only import what their functions need.
"""

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "skein.graph": ("DiGraph", "Graph", "PropGraph"),
    "skein.generators": (
        "barabasi_albert_graph", "complete_graph", "empty_graph", "gnm_edges", "gnp_random_graph", "karate_club_graph", "path_graph",
        "random_tree", "rmat_gen", "rmat_graph", "watts_strogatz_graph",
    ),
    "skein.operators.traversal": ("bfs_layers", "component_ids", "connected_components", "count_components", "diameter", "diameter_of"),
    "skein.operators.cohesion": (
        "count_triangles", "jaccard", "k_truss", "max_truss", "squares", "triangle_centrality", "triangles", "triangles_per_vertex", "truss_decomposition",
    ),
    "skein.operators.communities": ("min_cut", "well_connected_clusters", "well_connected_components"),
    "skein.operators.matching": ("match_table", "subgraph_isomorphism", "subgraph_monomorphism", "triads", "with_multiplicities"),
    "skein.sources.files": (
        "graph_file_read", "graph_file_read_mtx", "preprocess_edge_file", "read_clusters", "read_edge_list", "read_matrix_market_file", "read_tsv_file",
        "relabelled", "relabelling", "write_clusters", "write_edge_list", "write_jaccard", "write_nde",
    ),
    "skein.functions.sequences": ("SArrays", "lcp_array", "lcs", "suffix_array", "suffix_array_file"),
    "skein.streaming.sketch": ("read_stream", "sketch", "stream_pl_tri_cnt", "stream_tri_cnt"),
}
_HOME = {name: module for module, names in _WHERE.items() for name in names}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
