"""Graphs as tables of edges, vertices and attributes."""

from skein.graph.core import DiGraph, Graph
from skein.graph.property import PropGraph

__all__ = ["DiGraph", "Graph", "PropGraph"]
